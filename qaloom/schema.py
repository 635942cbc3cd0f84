"""Schemas of the stored tables and of the change sets the operators return.

Facts are append-only. An operator never updates a table: it returns the rows to
add, the keys to drop, the audit rows and the refused requests.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


RECORDS = _table(
    ("position", _L), ("source_id", _S), ("instruction", _S),
    ("input", T.ArrayType(_S)), ("output", _S),
)
BATCHES = _table(
    ("id", _L), ("filename", _S), ("file_hash", _S), ("uploaded_at", _TS),
    ("imported_count", _L), ("skipped_count", _L), ("status", _S),
)
QUESTIONS = _table(
    ("id", _L), ("batch_id", _L), ("source_id", _S), ("instruction", _S),
    ("input", T.ArrayType(_S)), ("output", _S), ("imported_at", _TS),
)
LEASES = _table(
    ("question_id", _L), ("reviewer", _S), ("session_id", _S), ("assigned_at", _TS),
    ("last_activity_at", _TS), ("lease_expires_at", _TS),
)
REVIEWS = _table(
    ("id", _L), ("question_id", _L), ("decision", _S), ("notes", _S),
    ("reviewer", _S), ("reviewed_at", _TS),
)
AUDIT = _table(
    ("event_type", _S), ("question_id", _L), ("review_id", _L), ("actor", _S),
    ("details_json", _S), ("created_at", _TS),
)
FAILURES = _table(
    ("source_id", _S), ("instruction", _S), ("input", _S), ("output", _S),
    ("notes", _S), ("check", _S), ("row_hash", _S),
)
UNCHECKED = _table(("source_id", _S), ("reason", _S))
EXPORT_COLUMNS = ["instruction", "question", "output", "pass/fail", "notes"]
