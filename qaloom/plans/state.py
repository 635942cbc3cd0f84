"""The current tables after a change set, and their versions on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.skew import hash_rank

Tables = dict[str, DataFrame]


def without(table: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows of a table whose key is not among those gone."""
    keys = gone.select(F.col(gone_key or key).alias(key))
    return table.join(keys, key, "left_anti").select(table.columns)


def added(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), True)


def with_review_ids(tables: Tables, new: DataFrame) -> DataFrame:
    """New reviews with ids above every id ever given, also of reviews taken back.

    Ids grow from change to change; within one they follow a digest of the question.
    """
    last = F.greatest(
        tables["reviews"].select(F.max("id")).scalar(),
        tables["audit"].select(F.max("review_id")).scalar(), F.lit(0),
    )
    keyed = new.withColumn("_digest", F.sha2(F.col("question_id").cast("string"), 256))
    ranked = hash_rank(keyed, "_digest", "_rank")
    return ranked.withColumn("id", (F.col("_rank") + last).cast("bigint")).drop("_digest", "_rank")


def after_submit(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    new = with_review_ids(tables, changes["reviews"])
    return {
        **tables,
        "reviews": added(tables["reviews"], new),
        "leases": without(tables["leases"], changes["dropped_leases"], "question_id"),
    }


def after_claim(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    live = without(tables["leases"], changes["dropped"], "question_id")
    return {
        **tables,
        "leases": added(without(live, changes["leases"], "question_id"), changes["leases"]),
        "audit": added(tables["audit"], changes["audit"]),
    }


def after_skip(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    rows = {"leases": without(tables["leases"], changes["dropped"], "question_id")}
    if "audit" in changes:
        rows["audit"] = added(tables["audit"], changes["audit"])
    return {**tables, **rows}


def after_renew(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    kept = without(tables["leases"], changes["leases"], "question_id")
    return {**tables, "leases": added(kept, changes["leases"])}


def after_bulk_fail(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    replaced = changes["replaced_reviews"].withColumn("id", F.col("review_id"))
    new = with_review_ids(tables, changes["reviews"])
    kept = without(tables["reviews"], replaced, "id")
    return {
        **tables,
        "reviews": added(added(kept, replaced), new),
        "leases": without(tables["leases"], changes["dropped_leases"], "question_id"),
        "audit": added(tables["audit"], changes["audit"]),
    }


def after_reset(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    return {
        **tables,
        "reviews": without(tables["reviews"], changes["dropped"], "id", "review_id"),
        "audit": added(tables["audit"], changes["audit"]),
    }


def after_delete(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    return {
        **tables,
        "batches": without(tables["batches"], changes["dropped_batches"], "id", "batch_id"),
        "questions": without(tables["questions"], changes["dropped_questions"], "id", "question_id"),
        "leases": without(tables["leases"], changes["dropped_leases"], "question_id"),
        "audit": added(tables["audit"], changes["audit"]),
    }


def after_import(tables: Tables, changes: dict[str, DataFrame]) -> Tables:
    return {
        **tables,
        **{name: added(tables[name], changes[name]) for name in ("batches", "questions", "audit")},
    }


def save(tables: Tables, path: str, version: int) -> None:
    """Write every table under a new version; the version counts once all are written."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(version, version + 1).toDF("version").write.mode("append").parquet(f"{path}/complete")


def load(spark: SparkSession, path: str) -> Tables:
    """The tables of the newest complete version."""
    version = spark.read.parquet(f"{path}/complete").agg(F.max("version")).first()[0]
    names = ["batches", "questions", "leases", "reviews", "audit"]
    return {name: spark.read.parquet(f"{path}/{name}/version={version}") for name in names}
