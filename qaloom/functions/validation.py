"""Is one raw record, a JSON value of any shape, a usable record?

Each profile is one column: the message of the first check that fails, or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Required fields in the order they are reported, and messages.
FIELDS = ["id", "instruction", "input", "output"]
STORE_MESSAGES = {
    "object": "Record must be a JSON object.",
    "id": "Field 'id' must be an integer.",
    "instruction": "Field 'instruction' must be a string.",
    "input": "Field 'input' must be a string or an array of strings.",
    "output": "Field 'output' must be a string.",
}
BROWSER_MESSAGES = {
    "object": "Record must be an object.",
    "id": "id must be an integer.",
    "instruction": "instruction must be a string.",
    "input": "input must be a string or an array of strings.",
    "output": "output must be a string.",
}
CHECKER_MESSAGES = {
    "object": "record is not an object",
    "text": "instruction or output is not a string",
    "input": "input is not a string or an array of strings",
}


def field(record: Column, name: str) -> Column:
    """The value of a field; JSON null is a value, only an absent field is null."""
    return F.try_variant_get(record, f"$.{name}", "variant")


def kind(record: Column, name: str) -> Column:
    return F.schema_of_variant(field(record, name))


def is_object(record: Column) -> Column:
    return F.try_variant_get(record, "$", "map<string,variant>").isNotNull()


def is_text(record: Column, name: str) -> Column:
    return F.coalesce(kind(record, name) == "STRING", F.lit(False))


def is_parts(record: Column) -> Column:
    """A string, or an array that holds nothing but strings (an empty one too).

    The schema of an array passes over its nulls, so those are looked for.
    """
    shape = kind(record, "input")
    listed = F.try_variant_get(record, "$.input", "array<string>")
    strings = (shape == "ARRAY<STRING>") & F.forall(listed, lambda p: p.isNotNull())
    empty = (shape == "ARRAY<VOID>") & (F.size(listed) == 0)
    return F.coalesce((shape == "STRING") | strings | empty, F.lit(False))


def is_integer(record: Column) -> Column:
    """An integer literal. Beyond 64 bits Spark reads one as a decimal without scale."""
    shape = kind(record, "id")
    wide = shape.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return F.coalesce((shape == "BIGINT") | wide, F.lit(False))


def is_whole_number(record: Column) -> Column:
    """Any number without a fraction, so that 2.0 counts too."""
    value = F.try_variant_get(record, "$.id", "double")
    shape = kind(record, "id")
    number = (shape == "BIGINT") | (shape == "DOUBLE") | shape.startswith("DECIMAL(")
    return F.coalesce(number & (value % 1 == 0), F.lit(False))


def _first(*checks: tuple[Column, str | Column]) -> Column:
    """Message of the first failed check; a check names what goes wrong."""
    return F.coalesce(*[F.when(failed, message) for failed, message in checks])


def _typed(record: Column, messages: dict[str, str], integer: Column) -> Column:
    return _first(
        (~integer, messages["id"]),
        (~is_text(record, "instruction"), messages["instruction"]),
        (~is_parts(record), messages["input"]),
        (~is_text(record, "output"), messages["output"]),
    )


def _store(record: Column) -> Column:
    absent = F.array_compact(F.array(*[F.when(field(record, n).isNull(), F.lit(n)) for n in FIELDS]))
    return F.coalesce(
        _first(
            (~is_object(record), STORE_MESSAGES["object"]),
            (F.size(absent) > 0,
             F.concat(F.lit("Missing required field(s): "), F.array_join(absent, ", "), F.lit("."))),
        ),
        _typed(record, STORE_MESSAGES, is_integer(record)),
    )


def _browser(record: Column) -> Column:
    shape = F.schema_of_variant(record)
    structure = F.coalesce(shape.startswith("OBJECT<") | shape.startswith("ARRAY<"), F.lit(False))
    return F.coalesce(
        F.when(~structure, BROWSER_MESSAGES["object"]),
        _typed(record, BROWSER_MESSAGES, is_whole_number(record)),
    )


def _api(record: Column) -> Column:
    """Types of the hosted interface: whole numbers, also as text or truth value."""
    shape = kind(record, "id")
    as_text = (shape == "STRING") & F.try_variant_get(record, "$.id", "string").rlike(
        r"^\s*[+-]?\d+(\.0*)?\s*$"
    )
    integer = is_whole_number(record) | F.coalesce((shape == "BOOLEAN") | as_text, F.lit(False))
    return F.coalesce(
        F.when(~is_object(record), BROWSER_MESSAGES["object"]),
        _typed(record, BROWSER_MESSAGES, integer),
    )


def _checker(record: Column) -> Column:
    return _first(
        (~is_object(record), CHECKER_MESSAGES["object"]),
        (~is_text(record, "instruction") | ~is_text(record, "output"), CHECKER_MESSAGES["text"]),
        (~is_parts(record), CHECKER_MESSAGES["input"]),
    )


PROFILES = {"store": _store, "browser": _browser, "api": _api, "checker": _checker}


def error_message(record: Column, profile: str = "store") -> Column:
    return PROFILES[profile](record)


def parts(record: Column) -> Column:
    """The input as a list of parts; a bare string becomes a list of one."""
    return F.when(
        kind(record, "input") == "STRING", F.array(F.try_variant_get(record, "$.input", "string"))
    ).otherwise(F.try_variant_get(record, "$.input", "array<string>"))


def source_id(record: Column) -> Column:
    """The id as text; empty when there is none."""
    shape, text = kind(record, "id"), F.try_variant_get(record, "$.id", "string")
    whole = F.try_variant_get(record, "$.id", "double")
    return (
        F.when(shape.isNull(), "").when(shape == "VOID", "None")
        .when(shape == "BOOLEAN", F.initcap(text))
        .when((shape == "DOUBLE") & (whole % 1 == 0), whole.cast("decimal(38,0)").cast("string"))
        .otherwise(text)
    )


def label(record: Column, row: Column) -> Column:
    """What a refused record is called: its id, else its row number."""
    named = is_object(record) & field(record, "id").isNotNull()
    return F.when(named, source_id(record)).otherwise(F.concat(F.lit("row "), row.cast("string")))
