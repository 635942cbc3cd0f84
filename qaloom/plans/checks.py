"""From upload files to failures: read, validate, judge, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from qaloom.operators import rules
from qaloom.sources import documents as docs
from qaloom.sources import sinks


def judge_raw(raw: DataFrame, data_type: str | Column) -> tuple[DataFrame, DataFrame]:
    """(judged records, malformed rows) of raw records."""
    records, malformed = docs.load_records(raw)
    return rules.judge(records, data_type), malformed


def check_files(
    spark: SparkSession, path: str | list[str], data_type: str, out: str,
    lines: bool = False, fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Check upload files and write failures, unchecked rows and the summary.

    The judged records are written once and read for the three results, so no
    rule runs twice.
    """
    if lines:
        raw = docs.read_json_lines(spark, path)
    else:
        documents = docs.read_documents(spark, path)
        sinks.write_table(docs.refused_documents(documents), f"{out}/refused_files")
        raw = docs.raw_records(documents)
    judged, malformed = judge_raw(raw, data_type)
    sinks.write_table(judged, f"{out}/judged")
    sinks.write_table(malformed, f"{out}/malformed")
    judged, malformed = (spark.read.parquet(f"{out}/{n}") for n in ("judged", "malformed"))
    results = {
        "failures": rules.failure_rows(judged),
        "unchecked": rules.unchecked_rows(judged, malformed),
        "summary": rules.print_order(rules.summary(judged, malformed)),
    }
    sinks.write_failures(results["failures"], f"{out}/failures", fmt)
    sinks.write_unchecked(results["unchecked"], f"{out}/unchecked", fmt)
    return results
