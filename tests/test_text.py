"""Text functions against small Python statements of what they mean."""

import json
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.functions import tolerant_json as tj


def is_mark(c):
    return unicodedata.category(c)[0] == "P"


def every_character(spark):
    pairs = [(i, chr(i)) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    return spark.createDataFrame(pairs[:0x30000], "code int, c string")


def test_character_classes_hold_for_every_assigned_character(spark):
    df = every_character(spark).select(
        "c", tx.has_punctuation(F.col("c")).alias("mark"), tx.has_latin_letter(F.col("c")).alias("latin"),
        (tx.strip(F.concat("c", F.lit("x"), "c")) == "x").alias("blank"))
    wrong = [r.c for r in df.collect() if (r.mark, r.latin, r.blank) != (
        is_mark(r.c), r.c.isalpha() and "LATIN" in unicodedata.name(r.c, ""), r.c.isspace())]
    assert wrong == []


ALPHABET = st.sampled_from(list("ab.,!?-«؟… \n\t\x1f　é\"'_$\U00010f86\U0001d400🔥ك"))
TEXTS = st.lists(st.text(ALPHABET, max_size=24), min_size=20, max_size=40)
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def fold(c):
    i = tx.FOLDED_MARKS.find(c)
    return tx.PLAIN_MARKS[i] if i >= 0 else c


def bare_words(text):
    out = []
    for token in text.split():
        while token and is_mark(token[0]):
            token = token[1:]
        while token and is_mark(token[-1]):
            token = token[:-1]
        out += [token] if token else []
    return out


@SLOW
@given(TEXTS)
def test_words_marks_and_strip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    got = df.orderBy("i").select(
        tx.words(t).alias("w"), tx.punctuation_set(t).alias("p"), tx.strip(t).alias("s"),
        tx.trim_punctuation(t).alias("m"), tx.stored_input(F.array(t, t)).alias("j")).collect()
    for text, row in zip(texts, got, strict=True):
        assert row.w == bare_words(text)
        assert row.p == sorted({fold(c) for c in text if is_mark(c)})
        assert row.s == text.strip()
        start, end = 0, len(text)
        while start < end and is_mark(text[start]):
            start += 1
        while end > start and is_mark(text[end - 1]):
            end -= 1
        assert row.m == text[start:end]
        assert row.j.lower() == json.dumps([text, text], ensure_ascii=False).lower()


def plain_strip_comments(text):
    """Comments out, literals kept, one character at a time."""
    out, i = "", 0
    while i < len(text):
        if text[i] == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out += text[i:j + 1]
            i = j + 1
        elif text.startswith("//", i):
            j = text.find("\n", i)
            i = len(text) if j < 0 else j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            i = len(text) if j < 0 else j + 2
        else:
            out += text[i]
            i += 1
    return out


@SLOW
@given(st.lists(st.text(st.sampled_from(list('a"\\/*\n,]} ')), max_size=20), min_size=40, max_size=60))
def test_comments(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.s for r in df.orderBy("i").select(tj.strip_comments(F.col("t")).alias("s")).collect()]
    assert got == [plain_strip_comments(t) for t in texts]


def test_trailing_commas(spark):
    cases = {
        "[1, ]": "[1 ]", "[1,,]": "[1,]", '{"a": 1,　}': '{"a": 1　}', '[",]"]': '[",]"]',
        '["a\\",]",]': '["a\\",]"]', "[1,2]": "[1,2]", '",}': '",}', "a, b": "a, b",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.s for r in df.orderBy("i").select(tj.drop_trailing_commas(F.col("t")).alias("s")).collect()]
    assert got == list(cases.values())


def test_long_literals_and_runs_of_marks_are_read_in_one_go(spark):
    long = '"' + '\\"x' * 200_000 + '" // gone'
    df = spark.createDataFrame([(long, "." * 300_000 + "a")], "t string, m string")
    row = df.select(F.length(tj.relax(F.col("t"))).alias("n"), tx.words(F.col("m")).alias("w")).first()
    assert row.n == len(long) - len("// gone") and row.w == ["a"]
