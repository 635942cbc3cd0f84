"""Reviewer and daily counts that follow a growing review log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per UTC day on a stream, however late they arrive; the state is one row per day."""
    day = F.date_format("reviewed_at", "yyyy-MM-dd").alias("date")
    return reviews.groupBy(day).agg(F.count(F.lit(1)).alias("reviews"))


def reviewer_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per reviewer on a stream; the state is one row per reviewer."""
    return reviews.groupBy("reviewer").agg(F.count(F.lit(1)).alias("reviews"))


def keep_latest(counts: DataFrame, path: str, checkpoint: str):
    """Write every changed count under its micro-batch; ``latest`` reads them."""
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest count of each key."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by("reviews", "batch").alias("reviews"))
