"""Turning validated uploads into stored batches and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.operators import audit
from qaloom.operators.skew import hash_rank, join_unique, mark_repeats
from qaloom.sources import documents as docs

# Refusal messages.
DUPLICATE_FILE = "This exact file has already been uploaded."
NOT_OPEN = "Import is not open."

# Question ids carry their upload in the high bits and their row in the low ones,
# so ids are unique and stable with no counting across uploads.
ROW_BITS = 32


def dedupe_files(files: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``reason`` to files whose bytes came before, under whatever name.

    ``history`` holds the ``file_hash`` of stored uploads.
    """
    marked = mark_repeats(files, ["file_hash"], F.col("file"), "_repeat")
    known = history.select("file_hash", F.lit(True).alias("_known")).distinct()
    return (
        marked.join(known, "file_hash", "left")
        .withColumn("reason", F.when(F.col("_repeat") | F.coalesce("_known", F.lit(False)), DUPLICATE_FILE))
        .drop("_repeat", "_known")
    )


def question_id(batch_id: Column, row: Column) -> Column:
    return F.shiftleft(batch_id.cast("bigint"), ROW_BITS) + row.cast("bigint")


def import_records(
    files: DataFrame, raw: DataFrame, history: DataFrame, as_of: Column, profile: str = "store"
) -> dict[str, DataFrame]:
    """Batches, questions, audit rows, refused files and refused rows of a load.

    ``files``: file, filename, file_hash. ``raw``: file, row, record. ``history`` is
    the stored batch table; new ids follow its highest one in the order of the file
    hashes, so the same load gets the same ids again.
    """
    judged_files = dedupe_files(files.select("file", "filename", "file_hash"), history)
    fresh = judged_files.where(F.col("reason").isNull()).drop("reason")
    last = F.coalesce(history.select(F.max("id")).scalar(), F.lit(0))
    numbered = hash_rank(fresh, "file_hash", "_rank").withColumn(
        "batch_id", (F.col("_rank") + last).cast("bigint")
    ).drop("_rank")
    judged = docs.validated(
        join_unique(raw, numbered.select("file", "batch_id"), ["file"], "inner"), profile
    )
    batches = (
        numbered.join(docs.preview_counts(judged), "file", "left")
        .fillna(0, ["valid_count", "skipped_count"])
        .select(
            F.col("batch_id").alias("id"), "filename", "file_hash", as_of.alias("uploaded_at"),
            F.col("valid_count").alias("imported_count"), "skipped_count",
            F.lit("ready").alias("status"),
        )
    )
    questions = docs.fields(judged.where(F.col("message").isNull())).select(
        question_id(F.col("batch_id"), F.col("row")).alias("id"), "batch_id", "source_id",
        "instruction", "input", "output", as_of.alias("imported_at"),
    )
    details = F.struct(
        F.col("id").alias("batch_id"), "filename", F.col("imported_count").alias("imported"),
        F.col("skipped_count").alias("skipped"),
    )
    return {
        "batches": batches,
        "questions": questions,
        "audit": audit.rows(batches, "import", as_of, F.lit("admin"), question_id=None, details=details),
        "refused_files": judged_files.where(F.col("reason").isNotNull()).select("file", "filename", "reason"),
        "refused_rows": judged.where(F.col("message").isNotNull()).select("file", "row", "message"),
    }


def import_documents(
    documents: DataFrame, history: DataFrame, as_of: Column, profile: str = "store"
) -> dict[str, DataFrame]:
    """``import_records`` of whole JSON documents; unreadable ones are refused too."""
    readable = documents.where(F.col("error").isNull())
    changes = import_records(readable, docs.raw_records(readable), history, as_of, profile)
    unreadable = docs.refused_documents(documents).withColumnRenamed("error", "reason")
    return {**changes, "refused_files": changes["refused_files"].unionByName(unreadable)}


def finish_imports(requests: DataFrame, batches: DataFrame) -> dict[str, DataFrame]:
    """Open uploads become ready; requests for any other are refused."""
    asked = requests.select("batch_id").distinct()
    state = batches.select(F.col("id").alias("batch_id"), "status")
    outcomes = asked.join(state, "batch_id", "left").withColumn(
        "reason",
        F.when(~F.coalesce(F.col("status") == "uploading", F.lit(False)), NOT_OPEN),
    ).drop("status")
    finished = outcomes.where(F.col("reason").isNull()).select(F.col("batch_id").alias("id"))
    return {
        "outcomes": outcomes,
        "batches": batches.join(finished, "id", "left_semi").withColumn("status", F.lit("ready")),
    }


def add_chunks(chunks: DataFrame, batches: DataFrame) -> dict[str, DataFrame]:
    """Counts of record chunks added to their open uploads.

    ``chunks``: batch_id, imported, skipped. Chunks of an upload that is not open
    are refused.
    """
    open_ids = batches.where("status = 'uploading'").select(F.col("id").alias("batch_id"))
    added = chunks.join(open_ids, "batch_id", "left_semi").groupBy(F.col("batch_id").alias("id")).agg(
        F.sum("imported").alias("_imported"), F.sum("skipped").alias("_skipped")
    )
    grown = batches.join(added, "id").withColumns({
        "imported_count": F.col("imported_count") + F.col("_imported"),
        "skipped_count": F.col("skipped_count") + F.col("_skipped"),
    }).drop("_imported", "_skipped")
    refused = chunks.join(open_ids, "batch_id", "left_anti").withColumn("reason", F.lit(NOT_OPEN))
    return {"batches": grown, "refused": refused}
