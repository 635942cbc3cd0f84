"""The append-only audit log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of audit events.
EVENT_TYPES = [
    "import", "lease_expired", "skip", "review_reset", "review_overridden", "auto_fail",
    "batch_deleted",
]


def rows(
    source: DataFrame, event_type: str, created_at: Column, actor: Column,
    question_id: str | None = "question_id", review_id: str | None = None,
    details: Column | None = None,
) -> DataFrame:
    """Audit rows for the rows of a change."""
    none = F.lit(None).cast("bigint")
    return source.select(
        F.lit(event_type).alias("event_type"),
        (F.col(question_id).cast("bigint") if question_id else none).alias("question_id"),
        (F.col(review_id).cast("bigint") if review_id else none).alias("review_id"),
        actor.cast("string").alias("actor"),
        (F.to_json(details) if details is not None else F.lit("{}")).alias("details_json"),
        created_at.cast("timestamp").alias("created_at"),
    )


def log(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
