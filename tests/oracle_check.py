"""Run registered queries against DuckDB: ``python tests/oracle_check.py [sf] [names…]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, build, sql: str | None) -> str | None:
    """None when both agree, else what differs."""
    frame = build(spark, sf_dir)
    columns, got = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    sql_columns, want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if columns != sql_columns:
        return f"columns {columns} / {sql_columns}"
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for c in cursor.description:
        if names.get(kinds[c[0]]) != str(c[1]):
            return f"type of {c[0]}: {kinds[c[0]]} / {c[1]}"
    if got != want:
        lost = [r for r in want if r not in got][:2] if len(want) < 5000 else []
        extra = [r for r in got if r not in want][:2] if len(want) < 5000 else []
        return f"{len(got)} rows / {len(want)} rows; only sql {str(lost)[:600]}; only spark {str(extra)[:600]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from qaloom.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    names = sys.argv[2:] or list(queries())
    session, con = local_session("8", 8), connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(session, con, sf_dir, queries()[name], oracle_sql().get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        kind = "sql" if name in oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
