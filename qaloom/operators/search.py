"""Review search and export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.schema import EXPORT_COLUMNS

# How many rows a search lists, and the bounds of that number.
DEFAULT_LIMIT, MAX_LIMIT = 500, 5000


def like_pattern(search: str) -> str:
    """Regular expression for "contains this": ``%`` and ``_`` stay wildcards.

    Only ASCII letters match without regard to case, and a backslash is itself.
    """
    wild = {"%": ".*", "_": "."}
    return "(?is)" + "".join(wild.get(c) or re.escape(c) for c in search)


def _contains(columns: list[Column], search: str) -> Column:
    pattern = like_pattern(search)
    found = F.lit(False)
    for column in columns:
        found = found | column.rlike(pattern)
    return found


def review_rows(reviews: DataFrame, questions: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Reviews with their question and, if given, the name of its upload."""
    asked = questions.select(
        F.col("id").alias("question_id"), "source_id", "batch_id", "instruction", "input", "output"
    )
    rows = reviews.withColumnRenamed("id", "review_id").join(asked, "question_id")
    if batches is not None:
        rows = rows.join(batches.select(F.col("id").alias("batch_id"), "filename"), "batch_id")
    return rows


def search_reviews(
    reviews: DataFrame, questions: DataFrame, batches: DataFrame,
    search: str = "", batch_id: int | None = None, limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Newest reviews whose question, decision text or upload contains ``search``."""
    if batch_id is not None:
        questions = questions.where(F.col("batch_id") == batch_id)
    rows = review_rows(reviews, questions, batches)
    token = search.strip()
    if token:
        stored = tx.stored_input(F.col("input"))
        columns = [F.col(c) for c in ("source_id", "instruction")] + [stored] + [
            F.col(c) for c in ("output", "notes", "reviewer", "filename")
        ]
        rows = rows.where(_contains(columns, token))
    newest = rows.orderBy(F.desc("reviewed_at"), F.desc("review_id"))
    return newest.limit(max(1, min(limit, MAX_LIMIT))).select(
        "review_id", "question_id", "source_id", "batch_id", "filename", "instruction",
        tx.input_text(F.col("input")).alias("question"), "output", "decision", "notes",
        "reviewer", "reviewed_at",
    )


def search_reviews_by_id(reviews: DataFrame, questions: DataFrame, search: str = "") -> DataFrame:
    """The hosted variant: five columns, highest review id first, always 500 rows."""
    rows = review_rows(reviews, questions)
    token = search.strip()
    if token:
        names = ("source_id", "instruction", "output", "notes", "reviewer")
        rows = rows.where(_contains([F.col(c) for c in names], token))
    return rows.orderBy(F.desc("review_id")).limit(DEFAULT_LIMIT).select(
        "review_id", "source_id", "instruction", tx.input_text(F.col("input")).alias("question"),
        "output", "decision", "notes", "reviewer", "reviewed_at",
    )


def with_decision(rows: DataFrame, decision: str = "All") -> DataFrame:
    """Rows of one decision among those already found; ``All`` keeps every row."""
    return rows if decision == "All" else rows.where(F.col("decision") == decision)


def export_rows(
    reviews: DataFrame, questions: DataFrame, batch_id: int | None = None, by_time: bool = True
) -> DataFrame:
    """Completed reviews in five columns, by review time (or by id, as hosted)."""
    if batch_id is not None:
        questions = questions.where(F.col("batch_id") == batch_id)
    order = ["reviewed_at", "review_id"] if by_time else ["review_id"]
    return (
        review_rows(reviews, questions).orderBy(*order)
        .withColumn("question", tx.input_text(F.col("input")))
        .withColumnRenamed("decision", "pass/fail")
        .select(*[f"`{c}`" for c in EXPORT_COLUMNS])
    )
