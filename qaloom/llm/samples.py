"""Bounded labelled samples that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: the CRC-32 of its id, as text, modulo the number of folds. Null ids: fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0).cast("bigint"))


def labelled(labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` documents outside the held-out fold, in the order of a hash of their id.

    Rows without an id or a label are passed over; of several labels of one id the largest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.where(fold(F.col("doc_id"), folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def with_texts(docs: DataFrame, sample: DataFrame, nbytes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, text) of the sampled documents in their order, as long as the texts stay under ``nbytes`` in all.

    Both bounds hold, so what is fitted on the driver does not grow with the corpus.
    """
    held = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # ``sample`` has at most as many rows as its parameter says.
    found = held.join(F.broadcast(sample), "doc_id").where(F.octet_length("text") <= nbytes)
    order = W.orderBy("near", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    sizes = found.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("near"))
    sizes = sizes.groupBy("doc_id", "near").agg(F.max("size").alias("size"))
    inside = sizes.withColumn("total", F.sum("size").over(order)).where(F.col("total") <= nbytes).select("doc_id")
    return found.join(F.broadcast(inside), "doc_id").groupBy("doc_id").agg(
        F.max("label").alias("label"), F.max("text").alias("text")
    ).orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text")
