"""Progress counts, reviewer and daily series, batch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.operators.skew import join_unique

# Fixed value: the reviewer name of automatic decisions.
AUTOMATIC_REVIEWER = "مراجعة آلية"


def question_state(
    questions: DataFrame, reviews: DataFrame, leases: DataFrame, as_of: Column,
    batches: DataFrame | None = None, batch_id: int | None = None,
) -> DataFrame:
    """Question id and batch with its decision and whether a live lease stands on it.

    Only ids, decisions and lease ends are shuffled, never a text. With ``batches``
    only questions of ready uploads count.
    """
    base = questions.select("id", "batch_id")
    if batch_id is not None:
        base = base.where(F.col("batch_id") == batch_id)
    if batches is not None:
        ready = batches.where("status = 'ready'").select(F.col("id").alias("batch_id"))
        base = base.join(ready, "batch_id", "left_semi")
    decided = reviews.select(F.col("question_id").alias("id"), "decision")
    held = leases.where(F.col("lease_expires_at") > as_of).select(
        F.col("question_id").alias("id"), F.lit(True).alias("live")
    )
    return base.join(decided, "id", "left").join(held, "id", "left")


def _counts() -> list[Column]:
    def n(test: Column) -> Column:
        return F.count_if(test)

    reviewed = F.col("decision").isNotNull()
    assigned = ~reviewed & F.coalesce(F.col("live"), F.lit(False))
    return [
        F.count(F.lit(1)).alias("total"), n(reviewed).alias("reviewed"),
        n(F.col("decision") == "Pass").alias("passed"), n(F.col("decision") == "Fail").alias("failed"),
        n(assigned).alias("assigned"),
    ]


def pass_rate(passed: Column, reviewed: Column) -> Column:
    """Percent with one decimal, halves to even; 0 when nothing is reviewed."""
    return F.when(reviewed > 0, F.bround(passed / reviewed * 100, 1)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def progress(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of ``question_state``, over everything or per ``by``."""
    counts = state.groupBy(*(by or [])).agg(*_counts())
    return counts.select(
        "*",
        F.greatest(F.col("total") - F.col("reviewed") - F.col("assigned"), F.lit(0)).alias("pending"),
        pass_rate(F.col("passed"), F.col("reviewed")).alias("pass_rate"),
        share(F.col("reviewed"), F.col("total")).alias("progress_ratio"),
    )


def reviews_in(reviews: DataFrame, questions: DataFrame, batch_id: int | None) -> DataFrame:
    """Reviews of one upload; every review of a known question when none is named."""
    known = questions if batch_id is None else questions.where(F.col("batch_id") == batch_id)
    return reviews.join(known.select(F.col("id").alias("question_id")), "question_id", "left_semi")


def by_reviewer(reviews: DataFrame) -> DataFrame:
    counts = reviews.groupBy("reviewer").agg(F.count(F.lit(1)).alias("reviews"))
    return counts.orderBy(F.desc("reviews"), "reviewer")


def over_time(reviews: DataFrame) -> DataFrame:
    days = reviews.groupBy(tx.utc_day(F.col("reviewed_at")).alias("date"))
    return days.agg(F.count(F.lit(1)).alias("reviews")).orderBy("date")


def share_of_max(series: DataFrame, value: str = "reviews") -> DataFrame:
    """Each value as percent of the largest one, 0 when that is 0."""
    largest = series.select(F.max(value)).scalar()
    percent = F.coalesce(F.try_divide(F.col(value), largest) * 100, F.lit(0.0))
    return series.withColumn("percent", percent)


def auto_vs_human(reviews: DataFrame) -> DataFrame:
    kind = F.when(F.col("reviewer") == AUTOMATIC_REVIEWER, "automatic").otherwise("human")
    return reviews.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col("decision") == "Fail").alias("failed"),
    )


def batch_counts(questions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored and reviewed questions per upload, aggregated before any join on it."""
    reviewed = reviews.select(F.col("question_id").alias("id"), F.lit(1).alias("has_review"))
    return (
        questions.select("id", "batch_id").join(reviewed, "id", "left")
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("stored"), F.count("has_review").alias("reviewed"))
    )


def batch_list(batches: DataFrame, questions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every upload, newest first, with what it holds; empty uploads count 0."""
    counts = batch_counts(questions, reviews).withColumnRenamed("batch_id", "id")
    return (
        batches.join(counts, "id", "left")
        .fillna(0, ["stored", "reviewed"])
        .orderBy(F.desc("id"))
    )


def held_back(listed: DataFrame) -> DataFrame:
    """Uploads that were never finished, and the questions stored in them."""
    waiting = F.col("status") != "ready"
    return listed.select(
        F.coalesce(F.sum(F.when(waiting, F.col("stored"))), F.lit(0)).alias("questions"),
        F.count_if(waiting).alias("uploads"),
    )
