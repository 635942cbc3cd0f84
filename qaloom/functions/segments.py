"""Splitting text into prose and the JSON written inside it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.tolerant_json import read_at, strict_decoder

# A fenced block, and the white space trimmed from its body.
FENCE = r"```[a-zA-Z]*[ \t]*\r?\n?([\s\S]*?)```"
BLANK = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_SEGMENTS = "array<struct<text string, is_json boolean>>"


def json_body(decoder: json.JSONDecoder, body: str) -> bool:
    """Whether a whole text is one JSON object or array."""
    found = read_at(decoder, body, 0) if body[:1] in ("{", "[") else None
    return found is not None and found[1] == len(body)


def inline_json(decoder: json.JSONDecoder, text: str) -> Iterator[tuple[str, bool]]:
    """Prose and bare JSON of a text in order; what does not parse stays prose."""
    prose_from = 0
    opener = re.compile(r"[{\[]")
    candidate = opener.search(text)
    while candidate:
        start = candidate.start()
        found = read_at(decoder, text, start)
        if found:
            if start > prose_from:
                yield text[prose_from:start], False
            yield text[start:found[1]], True
            prose_from = found[1]
        candidate = opener.search(text, found[1] if found else start + 1)
    if prose_from < len(text):
        yield text[prose_from:], False


def segments_of(decoder: json.JSONDecoder, text: str) -> list[dict[str, object]]:
    """All segments of one text; fenced JSON comes without its fence."""
    pieces: list[tuple[str, bool]] = []
    cursor = 0
    for fence in re.finditer(FENCE, text):
        body = fence.group(1).strip(BLANK)
        if json_body(decoder, body):
            pieces += [*inline_json(decoder, text[cursor:fence.start()]), (body, True)]
            cursor = fence.end()
    pieces += inline_json(decoder, text[cursor:])
    return [{"text": t, "is_json": j} for t, j in pieces or [(text, False)]]


def _split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    decoder = strict_decoder()
    for texts in batches:
        yield texts.map(lambda t: None if t is None else segments_of(decoder, t))


def segments(df: DataFrame, text: str, out: str = "segments") -> DataFrame:
    """Add ``out``: ``array<struct<text, is_json>>``.

    Only texts with an opening bracket pass through Python.
    """
    candidate = F.when(F.col(text).rlike(r"[{\[]"), F.col(text))
    whole = F.array(F.struct(F.col(text).alias("text"), F.lit(False).alias("is_json")))
    return (
        df.withColumn("_candidate", candidate)
        .withColumn("_split", F.pandas_udf(_split, _SEGMENTS)(F.col("_candidate")))
        .withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce("_split", whole)))
        .drop("_candidate", "_split")
    )


def contains_json(segments_col: Column) -> Column:
    return F.exists(segments_col, lambda s: s["is_json"])


def json_segments(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per segment: keys, ix, text, is_json, and the JSON value."""
    rows = segments(df, text).select(*keys, F.posexplode("segments").alias("ix", "s"))
    return rows.select(
        *keys, "ix", "s.text", "s.is_json",
        F.when(F.col("s.is_json"), F.try_parse_json("s.text")).alias("json"),
    )
