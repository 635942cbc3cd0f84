"""MinHash fingerprints and near-duplicate classes against brute force."""

import random
from hashlib import sha256

import numpy as np

from llm.helpers import frame, odd_texts
from qaloom.llm import minhash

FIXED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    size = min(5, len(words))
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 12, 60, 200]))) for _ in range(n)]
    for k in range(n // 2):
        own = texts[rng.randrange(n)].split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    return texts + odd_texts()


def test_fingerprints_against_brute_force(spark):
    texts = corpus(90)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    found = minhash.fingerprints(frame(spark, texts, ids))
    assert found.columns == FIXED
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    by_id = sorted(zip(ids, ["" if t is None else t for t in texts]))
    for k, (i, text) in enumerate(by_id):
        j, after = by_id[(k + 1) % len(by_id)]
        most = len(text) // 4
        new = text[:len(text) - most] + after[:most]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(new.encode()).hexdigest())
        own, other = np.frombuffer(bytes.fromhex(r.fingerprint), ">u2"), np.frombuffer(bytes.fromhex(r.edited_fingerprint), ">u2")
        assert r.near_edited == (own == other).mean() and (r.near_edited == 1.0 or shingles(text) != shingles(new))
        assert abs(r.near_edited - similarity(shingles(text), shingles(new))) < 0.2
        assert r.near_next == (own == np.frombuffer(bytes.fromhex(got[j].fingerprint), ">u2")).mean()
    same = {}
    for i, text in by_id:
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_the_estimate_is_close_on_average():
    rng, shingler = np.random.default_rng(3), minhash.Shingler()
    errors = []
    for _ in range(150):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        n = rng.integers(0, 400)
        a, b = pool[:300] >> np.uint64(31), pool[n // 4: 300 + n // 4] >> np.uint64(31)
        x, y = minhash.kept(minhash.least([a, b]))
        errors.append((x == y).mean() - similarity(set(a.tolist()), set(b.tolist())))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and len(shingler.words("A a")) == 2


def test_values_do_not_depend_on_blocks(monkeypatch):
    shingler = minhash.Shingler()
    texts = [t or "" for t in corpus(20)]
    alone = [minhash.kept(minhash.least([shingler.shingles(shingler.words(t))]))[0] for t in texts]
    monkeypatch.setattr(minhash, "BLOCK", 7)
    together = minhash.kept(minhash.least([shingler.shingles(shingler.words(t)) for t in texts]))
    assert (together == np.array(alone)).all()


def test_few_rows(spark):
    assert minhash.fingerprints(frame(spark, [])).collect() == []
    only = minhash.fingerprints(frame(spark, ["one two three four five six seven"])).first()
    assert only.near_next == 1.0
    null = minhash.fingerprints(frame(spark, [None, "a b", None], [None, None, 4])).collect()
    assert len(null) == 3 and sorted(r.n_chars for r in null) == [0, 0, 3]


def classes(texts, ids):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)]) for k, i in enumerate(ids))


def test_classes_against_all_pairs(spark):
    rng = random.Random(5)
    texts = corpus(120, seed=8)
    # A large group of near copies, a chain of small steps, and a passage that many unlike texts share.
    base = [f"v{k}" for k in range(150)]
    for k in range(60):
        texts.append(" ".join(base[:k] + [f"x{k}"] + base[k:]))
    for k in range(0, 100, 4):
        texts.append(" ".join(f"c{j}" for j in range(k, k + 120)))
    for k in range(40):
        texts.append(" ".join(base[:60] + [rng.choice("abcdef") + str(rng.random()) for _ in range(rng.choice([12, 15, 40]))]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    found = minhash.near_duplicates(frame(spark, texts, ids)).collect()
    assert sorted(map(tuple, found)) == classes(texts, ids)


def test_classes_of_few_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    found = minhash.near_duplicates(frame(spark, ["a b", None, "", "A  b", "a b"], [5, 6, None, 4, 5])).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(5, 4), (6, 6), (None, 6), (4, 4), (5, 4)], key=repr)
