"""Merkle manifests against trees built by hand."""

from hashlib import sha256

from pyspark.sql import functions as F

from llm.helpers import DOCS, odd_texts
from qaloom.llm import merkle


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    found = []
    for level in levels[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        found += run[:at % 16] + run[at % 16 + 1:]
        at //= 16
    return found


def by_hand(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r[0]) for r in rows if r[1] == source))
        trees.append(([x[3] for x in own], levels_of([x[2] for x in own])))
    top = levels_of([t[1][-1][0] for t in trees])
    out = []
    for at, (ids, levels) in enumerate(trees):
        for k, i in enumerate(ids):
            out.append((i, levels[0][k], levels[-1][0], top[-1][0], siblings(levels, k) + siblings(top, at)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, 0.0, "w", "f", "x") for i, s, lang, n, t in rows], DOCS)


def made(spark, rows, presented=None, **options):
    return merkle.verify(merkle.manifest(merkle.leaves(frame(spark, rows), presented)), siblings=True, **options)


def many(n: int) -> list[tuple]:
    """A hot source, a few others (one of 17, one of 16, one of 1, null, empty), odd texts, repeated rows and ids."""
    odd = odd_texts()
    sources = [None, "", "é", "z", "ab", "a"]
    rows = [(i, "hot" if i % 3 else sources[i % 5], "en" if i % 4 else None, i if i % 7 else None, odd[i % len(odd)]) for i in range(n)]
    rows += [(9000 + i, "seventeen", "en", 1, "t") for i in range(17)] + [(9100 + i, "sixteen", "en", 1, "t") for i in range(16)]
    return rows + [(9999, "alone", None, None, None), (5, "hot", "en", 5, odd[5]), (5, "hot", "en", 5, odd[5]), (None, "hot", None, 1, "x"), (None, None, None, None, None)]


def test_against_trees_built_by_hand(spark):
    rows = many(700)
    for part in (64, 50, 4096):
        got = made(spark, rows, part=part).collect()
        assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == sorted(by_hand(rows), key=repr)
        assert all(r.verified and r.folded_root == r.root and r.proof_sha256 == h("".join(r.proof)) for r in got)


def test_a_changed_row_is_told_and_only_that(spark):
    rows = many(120)
    got = made(spark, rows, F.when(F.col("doc_id") % 10 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!")))).collect()
    want = {repr(x[:2]): x for x in by_hand(rows)}
    for r in got:
        changed = r.doc_id is not None and r.doc_id % 10 == 3
        assert r.verified != changed and (r.folded_root == r.root) != changed
        assert r.root == want[repr((r.doc_id, r.leaf))][3]


def test_some_leaves_need_no_more_than_their_missing_nodes(spark):
    rows = many(500)
    got = made(spark, rows, wanted=F.col("doc_id") % 50 == 1, part=100).collect()
    want = {repr(x[:2]): x for x in by_hand(rows)}
    assert len(got) == sum(r[0] is not None and r[0] % 50 == 1 for r in rows)
    assert all((r.doc_id, r.leaf, r.subroot, r.root, r.proof) == want[repr((r.doc_id, r.leaf))] for r in got)


def test_the_union_of_missing_nodes_is_the_least():
    # Two neighbours under one run: 14 siblings, then 15 of the level above, then the other source.
    fetched, runs = merkle.plan([(0, 3), (0, 4)], {0: 256}, 2)
    assert fetched == [(0, 0, k) for k in range(16) if k not in (3, 4)] + [(0, 1, k) for k in range(1, 16)] + [(-1, 0, 1)]
    assert [r[:3] for r in runs] == [(0, 0, 0), (0, 1, 0), (-1, 0, 0)]
    # All leaves: nothing but the other trees.
    assert merkle.plan([(1, k) for k in range(40)], {1: 40}, 3)[0] == [(-1, 0, 0), (-1, 0, 2)]
    assert merkle.plan([(0, 0)], {0: 1}, 1) == ([], [])


def test_one_row_and_no_row(spark):
    only = made(spark, [(7, "s", None, 2, "ab")]).first()
    assert (only.leaf, only.proof, only.proof_sha256) == (h("1:71:s-1:22:ab"), [], h("")) and only.leaf == only.subroot == only.root
    assert made(spark, []).collect() == []
