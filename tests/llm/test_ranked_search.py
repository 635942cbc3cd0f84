"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from llm.helpers import frame, odd_texts
from qaloom.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs: list[tuple], items: list[tuple], most: int) -> list[tuple]:
    held = [(i, Counter(split(t))) for i, t in docs]
    n_docs = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(split(text)) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:most])]
    return sorted(out, key=repr)


def queries(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], "item_id bigint, text string, terms string, score int")


def got(spark, docs, items, most=50):
    found = ranked_search.search(frame(spark, [t for _, t in docs], [i for i, _ in docs]), queries(spark, items), most)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)


def corpus(n: int, seed: int = 3) -> list[tuple]:
    """Texts of a skewed vocabulary, copies (ties) and odd texts among them."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 20, 60])))) for i in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(n // 4)]
    docs += [(2 * n + k, t) for k, t in enumerate(odd_texts())]
    return docs + [(None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1])]


def test_against_scores_of_all_documents(spark):
    docs = corpus(300)
    items = [(1, "w0 w1 w2 W3, w3"), (2, "w50 w90 w119"), (3, None), (4, ""), (5, "nowhere"), (6, "Ünïcode word x"),
             (7, " ".join(f"w{k}" for k in range(70))), (7, "w7"), (8, "w1"), (8, "w1"), (None, "w2 word"), (9, docs[4][1])]
    for most in (50, 3):
        assert got(spark, docs, items, most) == by_hand(docs, items, most)


def test_small_shards_and_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus(120), [(k, f"w{k} w{2 * k} w{k + 40} w0") for k in range(12)]
    want = by_hand(docs, items, 10)
    for name, value in (("SHARD_DOCS", 9), ("BLOCK_TERMS", 7), ("FIRST", 1), ("BITMAP", 3), ("SHARD_PAIRS", 40)):
        monkeypatch.setattr(ranked_search, name, value)
    assert got(spark, docs, items, 10) == want


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] == got(spark, [(1, "a")], []) == got(spark, [(1, None)], [(1, "a")])


def test_reading_ends_early_and_keeps_ties():
    rng = np.random.default_rng(1)
    for trial in range(60):
        size, most = 400, 5
        lists = []
        for _ in range(rng.integers(1, 6)):
            doc = rng.permutation(size)[: rng.integers(1, size)]
            impact = np.sort(rng.integers(0, 30 if trial % 2 else 10**6, len(doc)))[::-1]
            lists.append((doc, impact))
        whole = np.zeros(size, np.int64)
        for doc, impact in lists:
            np.add.at(whole, doc, impact)
        floor = int(rng.integers(0, 40))
        least = max(1, floor, np.sort(whole)[-most])
        found, scores = ranked_search.nra(lists, size, most, floor)
        assert sorted(zip(found, scores)) == [(d, s) for d, s in enumerate(whole) if s >= least]
