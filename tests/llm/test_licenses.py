import random
import re

from llm.helpers import frame, odd_texts

from qaloom.llm import licenses

PHRASES = {label: text.split() for label, text in licenses.BASE}


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = {(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p)] == p}
    starts = sorted(i for i, _ in places)
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for _, x in places}))


def test_base_places_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    bits = [t for _, t in licenses.BASE] + ["Under the MIT-License", "cc by", "by nc cc", "the", "Apache License, Version 2.0", "licensed", "Ünter the mit license", "\n"]
    texts = odd_texts() + [" ".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(150)] + ["cc by nc " * 400]
    got = {r.doc_id: r for r in licenses.license_labels(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1) == (r.score == 1 or r.n_base > 0)


def test_a_template_with_words_more_and_less_is_one_span(spark):
    gpl = "this program comes under the terms of the gnu general public license as was published by the free software foundation"
    texts = [gpl, "under the terms of the gnu general manager as published in the free paper", "redistribution and use"]
    got = {r.doc_id: r.labels for r in licenses.license_labels(frame(spark, texts)).collect()}
    assert got == {0: "gpl", 1: "", 2: ""}


def test_repeated_rows_and_empty_tables(spark):
    docs = frame(spark, ["under the mit license", "under the mit license", "x"], [1, 1, None])
    got = licenses.license_labels(docs)
    assert sorted((r.doc_id or 0, r.n_base) for r in got.collect()) == [(0, 0), (1, 1), (1, 1)]
    assert licenses.license_labels(docs.limit(0)).count() == 0
