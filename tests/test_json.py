"""Tool schemas and JSON in free text, one property to a test."""

import json
import random

import pytest
from helpers import rec, records
from pyspark.sql import functions as F

from qaloom.functions import segments as sg
from qaloom.functions import tolerant_json as tj
from qaloom.functions import tools as tl
from qaloom.operators.rules import apply_rules


def numbered(spark, texts, column):
    return spark.createDataFrame(list(enumerate(texts)), f"i int, {column} string")


def tools(spark, *texts):
    found = tl.with_tools(numbered(spark, texts, "instruction")).orderBy("i").select("tools")
    return [r.tools for r in found.collect()]


def bare(name, **parameters):
    return {"name": name, "parameters": parameters}


def wrapped(name, **more):
    return {"type": "function", "function": {"name": name, **more}}


def test_notes_and_loose_commas_are_read_over_but_not_inside_strings(spark):
    text = '[{"name": "ferry//x", /* one, */ "parameters": {"properties": {"pier,": {}, "deck/*": {},}, "required": ["pier,",] , } }, ] // end'
    [[tool]] = tools(spark, text)
    assert (tool.name, sorted(tool.properties), tool.required) == ("ferry//x", ["deck/*", "pier,"], ["pier,"])


@pytest.mark.parametrize("entries", [
    [], [1, 2], ["ferry"], [{"pier": 1}], [{"name": "ferry"}], [{"name": 4, "parameters": {}}], [{"name": "ferry", "parameters": []}],
    [{"function": "ferry"}], [{"function": {"name": None}}], [bare("ferry"), {"pier": 1}],
])
def test_a_list_that_is_not_all_definitions_is_no_schema(spark, entries):
    assert tools(spark, "use " + json.dumps(entries)) == [None]


def test_text_and_single_definitions_are_no_schema(spark):
    assert tools(spark, "", "no list here", json.dumps(bare("ferry")), json.dumps("[]"), "[" + json.dumps(bare("ferry"))) == [None] * 5


def test_the_first_list_of_definitions_counts_wherever_it_stands(spark):
    one, two = json.dumps([bare("first", required=["a", None, "a", 2])]), json.dumps([wrapped("second")])
    got = tools(spark, f"[3] {one} {two}", f'{{"deep": {{"tools": {one}}}}} {two}', f"[ [{one}", f"{two} {one}")
    assert [[t.name for t in found] for found in got] == [["first"]] * 3 + [["second"]]
    assert got[0][0].required == ["a", "a"] and got[0][0].properties == []


def catalog_of(spark, *entries):
    df = numbered(spark, [json.dumps([e]) for e in entries], "instruction")
    found = tl.catalog(tl.with_tool_definitions(df), ["i"]).orderBy("i", "param").collect()
    return [(r.i, r.name, r.description, r.param, r.type, r.param_description, r.required) for r in found]


def test_catalog_has_a_row_for_each_parameter(spark):
    trip = wrapped("book_trip", description="books", parameters={"properties": {
        "when": {"type": "date", "description": "day"}, "seats": {"type": "int"}}, "required": ["when"]})
    assert catalog_of(spark, trip, wrapped("idle")) == [
        (0, "book_trip", "books", "seats", "int", "", False), (0, "book_trip", "books", "when", "date", "day", True),
        (1, "idle", "", None, None, None, None)]


def test_catalog_takes_what_is_no_text_as_missing_and_keeps_empty_names(spark):
    odd = bare("odd", properties={"": {"description": ["x"]}, "z": None}, required=[""])
    assert catalog_of(spark, {**odd, "description": {"a": 1}}) == [(0, "odd", "", "", "", "", True), (0, "odd", "", "z", "", "", False)]


def test_lint_lists_required_names_without_a_property(spark):
    lists = [["a"], ["a", "b", "b"], [], ["c"]]
    df = numbered(spark, [json.dumps([bare("t", properties={"a": {}}, required=r)]) for r in lists], "instruction")
    lint = tl.with_tools(df).select("i", tl.undeclared_required(F.col("tools"))[0]["undeclared"].alias("u")).orderBy("i")
    assert [r.u for r in lint.collect()] == [[], ["b", "b"], [], ["c"]]


FENCE = "`" * 3
WHOLE = ['{"tide": "low", "hours": [4, 5]}', '[{"tide": {}}, [], "x"]', '{"s": "brace } and [ in text"}', '"م"', "7", "", "plain words", "{open", "a } b ] c", "set{x}, y"]


@pytest.mark.parametrize("text", WHOLE)
def test_a_text_is_one_segment_if_it_is_json_or_holds_none(spark, text):
    [row] = sg.segments(numbered(spark, [text], "t"), "t").collect()
    assert [tuple(s) for s in row.segments] == [(text, text[:1] in ("{", "[") and text[-1:] in ("}", "]"))]


@pytest.mark.parametrize("pieces", [
    [("tide: ", False), ('{"low": 1}', True), (" and ", False), ("[2, 3]", True), (".", False)],
    [("{bad} then ", False), ('{"ok": {"deep": [1]}}', True)],
    [("[[", False), ("[9]", True), (" and {no}", False)],
    [("left } ", False), ('{"q": "\\"}{"}', True), (" right", False)],
])
def test_json_between_prose_is_cut_out(spark, pieces):
    [row] = sg.segments(numbered(spark, ["".join(p for p, _ in pieces)], "t"), "t").collect()
    assert [tuple(s) for s in row.segments] == pieces


def test_a_fenced_block_is_a_segment_if_its_body_is_json(spark):
    texts = [f"see {FENCE}json\n [1, 2] \n{FENCE} end", f"see {FENCE}\nwords only\n{FENCE} end"]
    first, second = sg.segments(numbered(spark, texts, "t"), "t").orderBy("i").collect()
    assert [tuple(s) for s in first.segments] == [("see ", False), ("[1, 2]", True), (" end", False)]
    assert [tuple(s) for s in second.segments] == [(texts[1], False)]


def test_long_form_has_the_parsed_values(spark):
    df = numbered(spark, ['a {"n": 1} b [2]', "none", "[3]"], "t")
    long = sg.json_segments(df, ["i"], "t").where("json is not null").groupBy("i").count()
    assert {r.i: r["count"] for r in long.collect()} == {0: 2, 2: 1}


def test_one_pass_relaxes_like_two(spark):
    rng = random.Random(5)
    marks = ['"', "\\", "/", "//", "/*", "*/", "*", ",", "}", "]", "{", "[", " ", "\n", "\t", "\u00a0", "a", "1", ":", '\\"', "$1"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    texts += [", /* a */ // b\n /* c */ ]", ", /* a */ b]", ",/* open ]", ',"//",]', "," + "/* x */ " * 20000 + "]", '"' + "\\n" * 20000]
    df = numbered(spark, texts, "t").orderBy("i")
    got = df.select(tj.relax(F.col("t")), tj.drop_trailing_commas(tj.strip_comments(F.col("t")))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_tools_are_those_of_the_definitions(spark):
    """Random schemas: names, parameters and lists of any type, entries wrapped or bare."""
    rng = random.Random(8)

    def value(depth=0):
        kinds = [1, 2.5, True, None, "s", "", [], {}, ["k", 3, None, "k", ["z"], "7"], {"k": {}, "v": 1, "w": {"x": [1]}, "": None}]
        return rng.choice(kinds)

    def function():
        parameters = {"properties": value(), "required": value(), "more": value()} if rng.random() < 0.7 else value()
        return {k: v for k, v in {"name": rng.choice(["f", "g", value()]), "parameters": parameters, "description": value()}.items() if rng.random() < 0.93}

    def entry():
        fn = function()
        return {"type": "function", "function": fn if rng.random() < 0.9 else value(), **(function() if rng.random() < 0.3 else {})} if rng.random() < 0.5 else fn

    texts = [json.dumps([entry() for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for _ in range(1500)]
    texts = [t if i % 3 else f"a [1] [ \n {{}}] [\t{t}, {{}}] {t} [{t}]" for i, t in enumerate(texts)]
    found = tl.with_tool_definitions(tl.with_tools(numbered(spark, texts, "instruction"))).orderBy("i")
    got = found.select("tools", F.transform("definitions", lambda fn: F.struct(
        F.try_variant_get(fn, "$.name", "string").alias("name"),
        F.coalesce(F.map_keys(F.try_variant_get(fn, "$.parameters.properties", "map<string,variant>")), F.array().cast("array<string>")).alias("properties"),
        tl.required_names(fn).alias("required"))).alias("want")).collect()
    assert [r.tools for r in got] == [r.want for r in got]
    assert 100 < sum(r.tools is not None for r in got) < 1400


def test_the_tool_rules_pass_rows_through_python_once_and_read_a_value_once(spark):
    plan = apply_rules(records(spark, rec()), "tool_calling")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("try_variant_get") == 2
