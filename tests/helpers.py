"""Small inputs for the tests."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from qaloom import schema


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def moment(text: str):
    return F.lit(text).cast("timestamp")


def records(spark, *rows):
    """(source_id, instruction, parts, output) rows in order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema.RECORDS)


def rec(instruction="لخص", parts=("",), output="", source_id="1"):
    return (source_id, instruction, list(parts), output)


def store(spark, batches=(), questions=(), leases=(), reviews=()):
    """Store tables. Questions: (id, batch, source_id, instruction, parts, output);
    leases: (question, reviewer, session, end); reviews: (id, question, decision, notes, reviewer, time)."""
    return {
        "batches": spark.createDataFrame(
            [(b, f"f{b}.json", f"h{b}", ts("2026-01-01"), 0, 0, s) for b, s in batches], schema.BATCHES),
        "questions": spark.createDataFrame(
            [(*q, ts("2026-01-01")) for q in questions], schema.QUESTIONS),
        "leases": spark.createDataFrame(
            [(q, r, s, ts("2026-01-01"), ts("2026-01-01"), ts(e)) for q, r, s, e in leases], schema.LEASES),
        "reviews": spark.createDataFrame(
            [(*r[:5], ts(r[5])) for r in reviews], schema.REVIEWS),
        "audit": spark.createDataFrame([], schema.AUDIT),
    }


def question(id, source_id="42", batch=1, instruction="لخص", parts=("نص",), output="ملخص"):
    return (id, batch, source_id, instruction, list(parts), output)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
