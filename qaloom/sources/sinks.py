"""Tables written for people and for the next job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from qaloom.schema import EXPORT_COLUMNS, FAILURES, UNCHECKED


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write as parquet, json or csv (with header; quotes doubled, text on many lines)."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.save(path)


def write_failures(failures: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(failures.select(*FAILURES.fieldNames()), path, fmt)


def write_unchecked(unchecked: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Kept apart from the failures, so that it can never be applied as one."""
    write_table(unchecked.select(*UNCHECKED.fieldNames()), path, fmt)


def write_export(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(rows.select(*[f"`{c}`" for c in EXPORT_COLUMNS]), path, fmt)
