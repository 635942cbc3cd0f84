"""Tool schemas in instructions and tool calls in outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import tolerant_json as tj

# The tags around a call.
CALL_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
CALL_TAG = "<tool_call>"

# What is read of a definition, an entry and a call. One cast to a shape reads a value once, where a path for each part would walk
# to it each time; what has another type becomes null. The values of a map mean nothing, null being the cheapest.
_FUNCTION = "name variant, parameters struct<properties map<string,boolean>, required array<variant>>"
_ENTRY = f"struct<{_FUNCTION}, `function` struct<{_FUNCTION}>>"
_CALL = "struct<name variant, arguments map<string,boolean>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _names(found: Column) -> Column:
    """Keys of a map; empty when there is none."""
    return F.coalesce(F.map_keys(found), F.array().cast("array<string>"))


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _text(value: Column, path: str) -> Column:
    """The string at a path, null when it is anything else."""
    return F.when(_is_text(_get(value, path)), F.try_variant_get(value, path, "string"))


def definition(entry: Column) -> Column:
    """The function definition in one array entry, wrapped or bare, else null."""
    return F.when(_is_text(_get(entry, "$.function.name")), _get(entry, "$.function")).when(
        _is_text(_get(entry, "$.name")) & F.try_variant_get(entry, "$.parameters", "map<string,boolean>").isNotNull(), entry
    )


def _whole(found: Column) -> Column:
    """An array, or null when it is empty or lacks an element."""
    return let(found, lambda all_: F.when((F.size(all_) > 0) & F.forall(all_, lambda x: x.isNotNull()), all_))


def definitions(value: Column) -> Column:
    """Definitions of a tool schema as ``array<variant>``; null when it is none.

    A tool schema is a non-empty array in which every entry is a definition.
    """
    return _whole(F.transform(F.try_variant_get(value, "$", "array<variant>"), definition))


def _strings(listed: Column) -> Column:
    """Strings of an ``array<variant>`` in order, repeats kept."""
    names = F.transform(F.filter(listed, _is_text), lambda v: v.try_cast("string"))
    return F.coalesce(names, F.array().cast("array<string>"))


def required_names(fn: Column) -> Column:
    """Strings of the ``required`` list in order, repeats kept."""
    return _strings(F.try_variant_get(fn, "$.parameters.required", "array<variant>"))


def tools(value: Column) -> Column:
    """``array<struct<name, properties, required>>`` of a tool schema; null where ``definitions`` is."""
    def tool(fn: Column) -> Column:
        return F.struct(
            fn["name"].try_cast("string").alias("name"),
            _names(fn["parameters"]["properties"]).alias("properties"),
            _strings(fn["parameters"]["required"]).alias("required"),
        )

    def read(entry: Column) -> Column:
        return F.when(_is_text(entry["function"]["name"]), tool(entry["function"])).when(
            _is_text(entry["name"]) & entry["parameters"].isNotNull(), tool(entry)
        )

    return _whole(F.transform(F.try_variant_get(value, "$", f"array<{_ENTRY}>"), read))


def _relaxed(text: Column) -> Column:
    """A text that may declare tools, made readable; null when it lacks one kind of opening bracket and so cannot."""
    return F.when(text.contains("[") & text.contains("{"), tj.relax(text))


def _first(relaxed: Column, spans: Column, read) -> Column:
    """What is read of the first value that is a tool schema."""
    found = F.transform(tj.values_at(relaxed, spans), read)
    return F.try_element_at(F.filter(found, lambda d: d.isNotNull()), F.lit(1))


def _with_first(df: DataFrame, text: str, out: str, read) -> DataFrame:
    return (
        df.withColumn("_relaxed", _relaxed(F.col(text)))
        .withColumn("_spans", tj.object_list_spans(F.col("_relaxed")))
        .withColumn(out, _first(F.col("_relaxed"), F.col("_spans"), read))
        .drop("_relaxed", "_spans")
    )


def with_tool_definitions(df: DataFrame, text: str = "instruction", out: str = "definitions") -> DataFrame:
    """Add the definitions offered by a text, null when it declares no tools.

    Rows without both kinds of opening bracket cannot hold a definition, so they
    pass null to the Python scanner instead of their text.
    """
    return _with_first(df, text, out, definitions)


def with_tools(df: DataFrame, text: str = "instruction", out: str = "tools") -> DataFrame:
    """Add ``out``: the tools offered by a text, or null."""
    return _with_first(df, text, out, tools)


def _call(payload: Column) -> Column:
    return let(F.try_variant_get(payload, "$", _CALL), lambda call: F.when(
        _is_text(call["name"]),
        F.struct(call["name"].try_cast("string").alias("name"), _names(call["arguments"]).alias("arguments")),
    ))


def _blocks(text: Column) -> Column:
    """What stands between the tags of each call, made readable."""
    return F.when(
        text.contains(CALL_TAG), F.transform(F.regexp_extract_all(text, F.lit(CALL_BLOCK), F.lit(1)), tj.relax)
    )


def _calls(blocks: Column, spans: Column) -> Column:
    payloads = F.zip_with(
        blocks, spans, lambda block, span: F.try_parse_json(F.substring(block, span["start"], span["length"]))
    )
    return _whole(F.transform(payloads, _call))


def with_calls(df: DataFrame, text: str = "output", out: str = "calls") -> DataFrame:
    """Add ``out``: every call a text makes, or null when one cannot be read.

    Null also when there is no call at all: either way nothing can be judged.
    """
    return (
        df.withColumn("_blocks", _blocks(F.col(text)))
        .withColumn("_block_spans", tj.first_object_spans(F.col("_blocks")))
        .withColumn(out, _calls(F.col("_blocks"), F.col("_block_spans")))
        .drop("_blocks", "_block_spans")
    )


def with_tools_and_calls(df: DataFrame, instruction: str, output: str, tools_out: str, calls_out: str) -> DataFrame:
    """Add both, as ``with_tools`` and ``with_calls`` do; the rows pass through Python once."""
    return (
        df.withColumns({"_relaxed": _relaxed(F.col(instruction)), "_blocks": _blocks(F.col(output))})
        .withColumns({
            "_spans": tj.object_list_spans(F.col("_relaxed")), "_block_spans": tj.first_object_spans(F.col("_blocks")),
        })
        .withColumns({
            tools_out: _first(F.col("_relaxed"), F.col("_spans"), tools),
            calls_out: _calls(F.col("_blocks"), F.col("_block_spans")),
        })
        .drop("_relaxed", "_blocks", "_spans", "_block_spans")
    )


def catalog(df: DataFrame, keys: list[str], definitions_col: str = "definitions") -> DataFrame:
    """Long tool catalog: one row per function and declared parameter.

    A function without parameters keeps one row with a null parameter. Missing or
    non-text names, types and descriptions become empty text; empty names stay.
    """
    fns = df.select(*keys, F.posexplode_outer(definitions_col).alias("fn_ix", "fn")).where("fn_ix is not null")
    fns = fns.select(
        *keys, "fn_ix",
        F.coalesce(_text(F.col("fn"), "$.name"), F.lit("")).alias("name"),
        F.coalesce(_text(F.col("fn"), "$.description"), F.lit("")).alias("description"),
        required_names(F.col("fn")).alias("required_names"),
        F.try_variant_get("fn", "$.parameters.properties", "map<string,variant>").alias("properties"),
    )
    long = fns.select("*", F.explode_outer("properties").alias("param", "spec"))
    return long.select(
        *keys, "fn_ix", "name", "description", "required_names", "param",
        F.when(F.col("param").isNotNull(), F.coalesce(_text(F.col("spec"), "$.type"), F.lit(""))).alias("type"),
        F.when(
            F.col("param").isNotNull(), F.coalesce(_text(F.col("spec"), "$.description"), F.lit(""))
        ).alias("param_description"),
        F.array_contains("required_names", F.col("param")).alias("required"),
    )


def undeclared_required(tools: Column) -> Column:
    """Per tool, the required names that are no declared property, repeats kept."""
    return F.transform(
        tools,
        lambda t: F.struct(
            t["name"].alias("name"),
            F.filter(t["required"], lambda r: ~F.array_contains(t["properties"], r)).alias("undeclared"),
        ),
    )
