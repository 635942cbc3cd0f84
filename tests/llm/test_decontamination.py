import random

from llm.helpers import frame, odd_texts

from qaloom.llm import decontamination


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


def test_items_within_the_budget_are_found_and_no_others(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(80)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [prose(rng.randint(8, 30)) for _ in range(12)] + ["short one", None, ""]
    texts = odd_texts()
    for k in range(60):
        letters = list(items[k % 12])
        for _ in range(rng.randint(0, len(letters) // 6)):
            at, what = rng.randrange(len(letters)), rng.randrange(3)
            letters[at:at + 1] = [[], ["x"], [letters[at], "y"]][what]
        texts.append(prose(30) + "... " + "".join(letters).upper() + "!! " + prose(rng.choice([0, 10, 40])))
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    found = decontamination.contaminations(docs, bench).collect()
    want = {}
    for d, text in enumerate(texts):
        clean = decontamination.normal(text)
        for i, item in enumerate(items[:12]):
            edits = plain_distance(item, clean) if clean else 99
            if edits <= decontamination.budget_of(len(item)):
                want[d, i] = edits
    whole = [r for r in found if r.share == 1 and r.item_id < 12]
    assert {(r.doc_id, r.item_id): r.edits for r in whole} == want and len(want) > 20 and len(whole) == len(want)
    assert all(plain_distance(items[r.item_id], r.region) == r.edits for r in whole)
    # A part is one of the item's windows, within its budget.
    for r in found:
        if r.share < 1:
            own = items[r.item_id]
            assert any(plain_distance(own[k:k + 64], r.region) <= 6 for k in decontamination.windows(len(own)))
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {r.doc_id for r in found}


def spread_edits(rng, text, n):
    """n edits at even distances, each a letter that is not in the text."""
    held = list(text)
    for k in range(n):
        at = (2 * k + 1) * len(text) // (2 * n)
        held[at] = rng.choice(["#", "", held[at] + "~"]).replace("#", "Q").replace("~", "Z")
    return "".join(held)


def test_items_of_all_lengths_are_found_with_all_edits_of_their_budget():
    rng = random.Random(11)
    for length in range(5, 140):
        item = "".join(rng.choice("abcdefghijklm") + (" " if k % 6 == 5 else "") for k in range(200))[:length].strip().ljust(length, "z")
        budget = decontamination.budget_of(length) if length >= decontamination.ALIGNED else 0
        block = decontamination.Block([(7, item)])
        for edits in {0, budget}:
            text = "xx yy uu " + spread_edits(rng, item, edits) + " ww vv"
            best = plain_distance(item, text)
            hits = [h for h in block.search(text) if h[4] == 1]
            assert [h[:2] for h in hits] == [(7, best)] and best <= edits, (length, edits)
            assert plain_distance(item, text[hits[0][2]:hits[0][3]]) == best


def test_short_items_stand_between_word_borders():
    block = decontamination.Block([(1, "who wrote hamlet"), (2, "谁写了红楼梦"), (3, "ham"), (4, "who wrote hamlet"), (5, "paris")])
    found = lambda text: sorted(h[0] for h in block.search(decontamination.normal(text)))
    assert found("Tell me: who WROTE Hamlet?!") == [1, 4] and found("who wrote hamlets") == [] == found("comparison")
    assert found("请问谁写了红楼梦呢") == [2] and found("paris, Paris. parish") == [5, 5] and found("") == []


def test_every_separate_copy_and_every_copied_part_is_found():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(300)]
    item = " ".join(words[:40])
    block = decontamination.Block([("a", item)])
    twice = item + " " + " ".join(words[60:80]) + " " + spread_edits(rng, item, 5) + " " + item
    assert [(h[1] <= 5, h[4]) for h in block.search(decontamination.normal(twice))] == [(True, 1.0)] * 3
    for first in range(0, len(item) - 96, 7):
        part = item[first:first + 96]
        hits = block.search("zz " + " ".join(words[100:140]) + " " + part + " " + " ".join(words[150:170]))
        assert len(hits) == 1 and 0 < hits[0][4] < 1 and hits[0][1] <= 6
    two_thirds = block.search(item[: 2 * len(item) // 3])
    assert len(two_thirds) == 1 and two_thirds[0][4] > 0.5
    assert block.search(" ".join(words[41:300])) == []


def test_repeated_letters_stay_within_bounds(monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE", 1 << 14)
    block = decontamination.Block([(1, "a" * 120), (2, "ab" * 30)])
    hits = block.search("a" * 3000)
    assert {h[0] for h in hits} == {1} and all(h[1] == 0 for h in hits)


def test_the_stage_moves_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = decontamination.drop_contaminated(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and kept.schema == docs.schema


def test_odd_columns_come_through(spark):
    docs = spark.sql("select 1 as doc_id, map('a', 1) as `m.x`, struct(1 as a, array('x') as b) as s, timestamp '2024-01-01 00:00:00' as t, "
                     "cast(null as string) as text union all select null, null, null, null, 'the quick brown fox jumps over it'")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "nothing else at all of this")], "item_id int, text string")
    assert decontamination.drop_contaminated(docs, bench).collect() == docs.where("doc_id = 1").collect()


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    words = [f"wo{k}rd{k % 7}" for k in range(400)]
    items = [" ".join(words[k * 20:k * 20 + 12]) for k in range(15)]
    docs = frame(spark, [" ".join(words), "nothing of that kind stands here at all"])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")

    def found():
        return sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.contaminations(docs, bench).collect())

    whole = found()
    assert whole == [(0, k, 0) for k in range(15)]
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    monkeypatch.setattr(decontamination, "PIECE", 200)
    assert found() == whole


def test_empty_tables(spark):
    docs = frame(spark, ["some text that is long enough to look at", "some text that is long enough to look at"], [1, 1])
    bench = spark.createDataFrame([(1, "some text that is long enough to look at")], "item_id int, text string")
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminations(docs.limit(0), bench).count() == 0
    assert decontamination.contaminations(docs, bench).count() == 2
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == 2
