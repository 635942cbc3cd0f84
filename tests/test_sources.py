"""Reading uploads, validation, imports, sinks."""

import json

import pytest
from helpers import moment, rows, store
from pyspark.sql import functions as F

from qaloom.functions import validation as vd
from qaloom.plans.checks import check_files
from qaloom.sources import documents as docs
from qaloom.sources import failures as fl
from qaloom.sources import imports as im
from qaloom.sources import sinks

GOOD = {"id": 1, "instruction": "i", "input": ["q"], "output": "o", "ignored": "extra"}


def write(folder, name, *records, raw=None):
    data = raw if raw is not None else json.dumps({"data": list(records)}, ensure_ascii=False).encode()
    (folder / name).write_bytes(data)


def messages(spark, profile, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = df.withColumn("m", vd.error_message(F.try_parse_json("t"), profile)).orderBy("i")
    return [r.m for r in found.collect()]


def variant(**changes):
    record = {**GOOD, **changes}
    return json.dumps({k: v for k, v in record.items() if v is not ...})


M, B, C = vd.STORE_MESSAGES, vd.BROWSER_MESSAGES, vd.CHECKER_MESSAGES
CASES = {
    variant(): (None, None, None, None),
    variant(input="q"): (None, None, None, None),
    variant(input=[]): (None, None, None, None),
    "[]": (M["object"], B["id"], B["object"], C["object"]),
    "null": (M["object"], B["object"], B["object"], C["object"]),
    "5": (M["object"], B["object"], B["object"], C["object"]),
    variant(output=..., id=...): ("Missing required field(s): id, output.", B["id"], B["id"], C["text"]),
    "{}": ("Missing required field(s): id, instruction, input, output.", B["id"], B["id"], C["text"]),
    variant(id=True): (M["id"], B["id"], None, None),
    variant(id="5"): (M["id"], B["id"], None, None),
    variant(id=None): (M["id"], B["id"], B["id"], None),
    variant(id=1.5): (M["id"], B["id"], B["id"], None),
    variant(id=2.0): (M["id"], None, None, None),
    variant(id=12345678901234567890123): (None, None, None, None),
    variant(instruction=None): (M["instruction"], B["instruction"], B["instruction"], C["text"]),
    variant(input=[3]): (M["input"], B["input"], B["input"], C["input"]),
    variant(input=["a", None]): (M["input"], B["input"], B["input"], C["input"]),
    variant(input=[None]): (M["input"], B["input"], B["input"], C["input"]),
    variant(input=5): (M["input"], B["input"], B["input"], C["input"]),
    variant(output=7): (M["output"], B["output"], B["output"], C["text"]),
}


@pytest.mark.parametrize("at, profile", list(enumerate(["store", "browser", "api", "checker"])))
def test_profiles(spark, at, profile):
    got = messages(spark, profile, *CASES)
    assert got == [want[at] for want in CASES.values()]


def test_documents(spark, tmp_path):
    write(tmp_path, "good.json", GOOD, {"id": 2})
    write(tmp_path, "bom.json", raw=b"\xef\xbb\xbf" + json.dumps({"data": [GOOD], "x": 1}).encode())
    write(tmp_path, "empty.json")
    bad = {"bytes": b'{"data": ["\xff"]}', "cut": b'{"data": [1', "after": b'{"data": []} x', "two": b'{"data": []}{}',
           "nan": b'{"data": [NaN]}', "blank": b" \n", "quotes": b"{'data': []}"}
    rootless = {"list": b"[1]", "rows": b'{"rows": []}', "text": b'"x"', "object": b'{"data": {}}', "null": b'{"data": null}'}
    for name, raw in {**bad, **rootless}.items():
        write(tmp_path, f"{name}.json", raw=raw)
    found = docs.read_documents(spark, str(tmp_path))
    errors = {r.filename[:-5]: r.error for r in found.collect()}
    assert errors == {"good": None, "bom": None, "empty": None, **dict.fromkeys(bad, docs.NOT_JSON),
                      **dict.fromkeys(rootless, docs.NO_DATA)}
    counts, refused = docs.preview(found)
    assert rows(counts, "filename", "valid_count", "skipped_count") == [
        ("bom.json", 1, 0), ("empty.json", 0, 0), ("good.json", 1, 1)]
    assert [r.row for r in refused.collect()] == [2]


def test_json_lines_are_numbered_in_file_order(spark, tmp_path):
    lines = [json.dumps({**GOOD, "id": i, "output": "x" * (i % 50)}) for i in range(1, 3001)]
    lines[4] = "{broken"
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 4
        raw = docs.read_json_lines(spark, str(tmp_path / "a.jsonl"))
        got = docs.validated(raw).select(
            "row", F.try_variant_get("record", "$.id", "int").alias("id"), "message").collect()
        digest = docs.lines_files(docs.read_lines(spark, str(tmp_path / "a.jsonl"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.row for r in got) == list(range(1, 3001))
    assert all(r.id == r.row for r in got if r.row != 5)
    assert [r.row for r in got if r.message] == [5]
    assert digest == docs.lines_files(docs.read_lines(spark, str(tmp_path / "a.jsonl"))).first() and digest.lines == 3001


def test_a_digest_is_that_of_the_bytes(spark, tmp_path):
    """Files that differ in blank lines, line ends, order, bytes that are no text, or by one line of many have different digests."""
    many = [f"line {i}" for i in range(3000)]
    texts = [b"a\nb\n", b"a\nb", b"a\n\nb\n", b"a\n\nb\n\n", b"\na\nb\n", b"a\r\nb\n", b"b\na\n", b"ab\n", b"\xff\nb\n", b"\xfe\nb\n", b"\n",
             b"\n\n", " é\n".encode(), "\n".join(many).encode(), "\n".join(many[:2047] + ["line x"] + many[2048:]).encode(),
             "\n".join(many[1024:2048] + many[:1024] + many[2048:]).encode()]
    for k, raw in enumerate(texts):
        (tmp_path / f"f{k}").write_bytes(raw)
        (tmp_path / f"g{k}").write_bytes(raw)
    found = {r.filename: r.file_hash for r in docs.lines_files(docs.read_lines(spark, str(tmp_path))).collect()}
    assert len(found) == 2 * len(texts) and len(set(found.values())) == len(texts)
    assert all(found[f"f{k}"] == found[f"g{k}"] for k in range(len(texts)))


def test_blank_lines_count_as_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n  \n{"id": 4}\r\n')
    got = docs.read_json_lines(spark, str(tmp_path / "a.jsonl"))
    assert rows(got.select("row", F.col("record").isNotNull()), "*") == [(1, True), (4, True)]
    assert dict(got.dtypes)["row"] == "bigint"


def test_checker_records(spark, tmp_path):
    write(tmp_path, "a.json", GOOD, {**GOOD, "id": 7, "input": [3]}, 5, {**GOOD, "id": "k", "input": "one"},
          {k: v for k, v in GOOD.items() if k != "id"}, {"instruction": 1})
    records, malformed = docs.load_records(docs.raw_records(docs.read_documents(spark, str(tmp_path))))
    assert rows(records, "position", "source_id", "input") == [(0, "1", ["q"]), (1, "k", ["one"]), (2, "", ["q"])]
    assert rows(malformed, "source_id", "reason") == [
        ("7", C["input"]), ("row 3", C["object"]), ("row 6", C["text"])]
    blocks = docs.position_valid(docs.validated(
        docs.raw_records(docs.read_documents(spark, str(tmp_path))), "checker"), block=2)
    assert rows(blocks, "position", "source_id") == [(0, "1"), (1, "k"), (2, "")]


def test_import_and_the_same_bytes_again(spark, tmp_path):
    for name in ("a.json", "b.json"):
        write(tmp_path, name, GOOD, {"id": 2, "instruction": "i", "input": ["q"]})
    write(tmp_path, "c.json", {**GOOD, "input": "bare"}, {**GOOD, "id": 12})
    write(tmp_path, "d.json", raw=b"{")
    found = docs.read_documents(spark, str(tmp_path))
    stored = store(spark, batches=[(3, "ready")])["batches"]
    changes = im.import_documents(found, stored, moment("2026-01-01"))
    batches = changes["batches"].collect()
    assert sorted((r.imported_count, r.skipped_count) for r in batches) == [(1, 1), (2, 0)]
    assert sorted(r.id for r in batches) == [4, 5]
    assert rows(changes["questions"], "source_id", "input") == [("1", ["bare"]), ("1", ["q"]), ("12", ["q"])]
    ids = [r.id for r in changes["questions"].collect()]
    assert len(set(ids)) == 3
    assert rows(changes["refused_files"], "filename", "reason") == [
        ("b.json", im.DUPLICATE_FILE), ("d.json", docs.NOT_JSON)]
    [(row, message)] = rows(changes["refused_rows"], "row", "message")
    assert row == 2 and "output" in message
    details = [json.loads(r.details_json) for r in changes["audit"].collect()]
    assert sorted((d["imported"], d["skipped"]) for d in details) == [(1, 1), (2, 0)]
    again = im.import_documents(found, stored.unionByName(changes["batches"]), moment("2026-01-02"))
    assert again["batches"].count() == 0 and again["questions"].count() == 0


def test_open_imports(spark):
    stored = store(spark, batches=[(1, "uploading"), (2, "ready")])["batches"]
    chunks = spark.createDataFrame([(1, 200, 1), (1, 50, 0), (2, 5, 0), (9, 5, 0)],
                                   "batch_id bigint, imported bigint, skipped bigint")
    added = im.add_chunks(chunks, stored)
    assert rows(added["batches"], "id", "imported_count", "skipped_count") == [(1, 250, 1)]
    assert rows(added["refused"], "batch_id", "reason") == [(2, im.NOT_OPEN), (9, im.NOT_OPEN)]
    done = im.finish_imports(spark.createDataFrame([(1,), (2,), (9,)], "batch_id bigint"), stored)
    assert rows(done["outcomes"], "batch_id", "reason") == [(1, None), (2, im.NOT_OPEN), (9, im.NOT_OPEN)]
    assert rows(done["batches"], "id", "status") == [(1, "ready")]


def failures(spark, *items):
    return spark.createDataFrame(list(items), "source_id string, notes string, row_hash string, instruction string")


def test_failure_reader(spark):
    good = ("1", " two\nlines ", "a" * 64, "kept apart")
    read = fl.read_failures(failures(spark, good, (None, None, None, None), (" ", "", "", "x")))
    assert read.columns == ["source_id", "notes", "row_hash"]
    assert [tuple(r) for r in read.collect()] == [("1", "two\nlines", "a" * 64)]
    assert fl.read_failures(failures(spark, good).where("false")).count() == 0
    for bad, text in (("1", "n", "short", ""), fl.BAD_HASH), (("1", " ", "a" * 64, ""), fl.MISSING):
        with pytest.raises(Exception, match=text):
            fl.read_failures(failures(spark, good, bad)).collect()
    with pytest.raises(ValueError, match="row_hash"):
        fl.read_failures(failures(spark, good).drop("row_hash"))


@pytest.mark.parametrize("lines", [False, True])
def test_check_files_end_to_end(spark, tmp_path, lines):
    data = [{**GOOD, "id": 1, "output": "ok"}, {**GOOD, "id": 2, "output": "تمام"}, {**GOOD, "id": 3, "input": [3]},
            {**GOOD, "id": 4, "input": ["x,\n\"y\""], "output": "نعم،"}]
    if lines:
        (tmp_path / "in.json").write_text("\n".join(json.dumps(r) for r in data))
    else:
        write(tmp_path, "in.json", *data)
    out = str(tmp_path / "out")
    check_files(spark, str(tmp_path / "in.json"), "arabizi", out, lines=lines, fmt="csv")
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    assert rows(read.csv(f"{out}/failures"), "source_id", "check") == [
        ("1", "english"), ("2", "duplicate"), ("4", "punctuation")]
    assert rows(read.csv(f"{out}/unchecked"), "source_id", "reason") == [("3", C["input"])]


def test_export_sink(spark, tmp_path):
    df = spark.createDataFrame([("i", "a\nb", "o", "Pass", "")], ["instruction", "question", "output", "pass/fail", "notes"])
    sinks.write_export(df, str(tmp_path / "e"), "json")
    assert spark.read.json(str(tmp_path / "e")).first()["pass/fail"] == "Pass"


def test_text_that_only_completes_the_wrapper_is_not_json(spark):
    texts = ['{"data":[1]}, "x": 2', '{"data":[1]}, "data": 5', '{"data":[1]},"value":{"data":[2]}', '{"data":[1]} , "end of text": 1', '{"data":[1]}}, {"a": {', "", '{"data":[1]}']
    got = docs.parse_documents(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.error for r in got] == [docs.NOT_JSON] * 6 + [None]


def test_json_lines_hold_one_value_each(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1}, "x": 2\n{"id":1}\n[1] [2]\n"t", "value": 3\n7\n')
    got = docs.read_json_lines(spark, str(tmp_path / "a.jsonl")).orderBy("row").collect()
    assert [r.record is None for r in got] == [True, False, True, True, False]
