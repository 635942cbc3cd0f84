"""Reading JSON that people wrote by hand: comments, trailing commas, prose around it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.text import SPACE

# A JSON string literal, closed or running to the end. Possessive, so that a long
# literal is read without backtracking and without deep recursion.
_LITERAL = r'("[^"\\]*+(?:\\[\s\S]?[^"\\]*+)*+(?:"|\z))'
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
_TRAILING_COMMA = rf",(?=[{SPACE}]*+[}}\]])"


def strip_comments(text: Column) -> Column:
    """Drop ``//`` and ``/* */`` comments outside string literals."""
    return F.regexp_replace(text, f"{_LITERAL}|{_COMMENT}", "$1")


def drop_trailing_commas(text: Column) -> Column:
    """Drop a comma whose next visible character closes an array or object."""
    return F.regexp_replace(text, f"{_LITERAL}|{_TRAILING_COMMA}", "$1")


# Text that stays: a stretch of literals and of marks that begin nothing that goes. What follows it is a comment or a trailing comma,
# which may have comments before its closing bracket. Frequent forms stand first: literals without escapes, commas before plain marks.
_WHOLE_LITERAL = r'"(?>[^"\\]*)(?:"|(?:\\[\s\S]?[^"\\]*+)++(?:"|\z)|\z)'
_KEPT_COMMA = rf",(?![{SPACE}/}}\]])|,(?!(?:[{SPACE}]|{_COMMENT})*+[}}\]])"
_STAYS = rf"""((?:(?>[^"/,]+)|{_WHOLE_LITERAL}|{_KEPT_COMMA}|/(?![/*]))++)"""


def relax(text: Column) -> Column:
    """The text without comments, and then without trailing commas, in one pass."""
    return F.regexp_replace(text, f"{_STAYS}|{_COMMENT}|,", "$1")


def strict_decoder() -> json.JSONDecoder:
    """A reader that, like the JSON type of Spark, knows no NaN and no Infinity."""
    def refuse(token: str):
        raise ValueError(token)

    return json.JSONDecoder(parse_constant=refuse)


def read_at(decoder: json.JSONDecoder, text: str, start: int) -> tuple[object, int] | None:
    """The JSON value that begins at ``start`` and its end, or None.

    A readable value ends where its bracket closes, so no bracket is counted here.
    """
    try:
        return decoder.raw_decode(text, start)
    except (ValueError, RecursionError):
        return None


# How a list begins whose first entry is an object.
_OBJECT_LIST = re.compile(r"\[(?=[ \t\n\r]*\{)")
_OBJECT = re.compile(r"\{")


def find_values(
    decoder: json.JSONDecoder, text: str | None, opener: re.Pattern, wanted=lambda value: True
) -> Iterator[dict[str, int]]:
    """Where wanted JSON values that begin with ``opener`` stand in one text (1-based)."""
    for candidate in opener.finditer(text or ""):
        start = candidate.start()
        found = read_at(decoder, text, start)
        if found and wanted(found[0]):
            yield {"start": start + 1, "length": found[1] - start}


def is_object_list(value: object) -> bool:
    return bool(value) and all(isinstance(entry, dict) for entry in value)


_SPANS = "array<struct<start int, length int>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _object_list_spans(texts: pa.Array) -> pa.Array:
    decoder = strict_decoder()
    return pa.array([list(find_values(decoder, t, _OBJECT_LIST, is_object_list)) for t in texts.to_pylist()], _ARROW_SPANS)


def _first_object_spans(lists: pa.Array) -> pa.Array:
    decoder = strict_decoder()
    return pa.array([
        None if blocks is None else [next(find_values(decoder, block, _OBJECT), None) for block in blocks]
        for blocks in lists.to_pylist()
    ], _ARROW_SPANS)


def object_list_spans(text: Column) -> Column:
    """Positions of every readable non-empty JSON array of objects, in text order.

    Arrays inside others count too. Positions, not copies: nested arrays would
    repeat the text once per level.
    """
    return F.arrow_udf(_object_list_spans, _SPANS)(text)


def first_object_spans(blocks: Column) -> Column:
    """For each text of an array, where its first readable JSON object stands."""
    return F.arrow_udf(_first_object_spans, _SPANS)(blocks)


def values_at(text: Column, spans: Column) -> Column:
    """The JSON values at the given positions, as ``array<variant>``."""
    return F.transform(
        spans, lambda s: F.try_parse_json(F.substring(text, s["start"], s["length"]))
    )
