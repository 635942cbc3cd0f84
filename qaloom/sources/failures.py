"""The failure set between the automatic checks and the review store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.functions import text as tx

# What the reader needs, and its messages.
REQUIRED = ["source_id", "notes", "row_hash"]
BAD_HASH = "no usable row_hash"
MISSING = "missing a source_id or notes"


def validated_failures(failures: DataFrame) -> DataFrame:
    """The three needed columns, trimmed, without blank rows, with ``reason``."""
    missing = [c for c in REQUIRED if c not in failures.columns]
    if missing:
        raise ValueError(f"missing the column(s): {', '.join(missing)}")
    kept = [c for c in ("position",) if c in failures.columns]
    clean = failures.select(
        *kept, *[tx.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in REQUIRED]
    )
    filled = clean.where(F.concat(*REQUIRED) != "")
    return filled.withColumn(
        "reason",
        F.when(F.length("row_hash") != 64, BAD_HASH)
        .when((F.col("source_id") == "") | (F.col("notes") == ""), MISSING),
    )


def read_failures(failures: DataFrame) -> DataFrame:
    """The items to apply. One bad row refuses the whole set, when it is read."""
    rows = validated_failures(failures)
    refuse = F.raise_error(F.concat(F.lit("A failure row has "), F.col("reason")))
    return rows.withColumn(
        "row_hash", F.when(F.col("reason").isNull(), F.col("row_hash")).otherwise(refuse.cast("string"))
    ).drop("reason")
