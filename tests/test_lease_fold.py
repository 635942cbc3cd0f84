"""The batch fold over cut logs against a walk of each question by itself."""

import random

from helpers import rows, ts
from pyspark.sql import functions as F

from qaloom.operators import skew
from qaloom.streaming import lease_fold as lf
from qaloom.streaming import lease_tracker as lt
from qaloom.streaming.lease_rules import Lease, advance, expired

SHOWN = ["question_id", "at", "event_id", "action", "outcome", "reviewer", "session_id", "decision", "notes", "reason", "lease_expires_at"]
START = int(ts("2026-01-01").timestamp() * 1_000_000)


def log(n, hot_share, step, reviewers, seed=1, submits=0.02):
    """Actions some seconds apart; a share of all is on question 1, without a pause."""
    rng = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += rng.choice(step)
        action = "submit" if rng.random() < submits else rng.choice(["claim", "claim", "renew", "renew", "skip"])
        out.append((i, at, 1 if rng.random() < hot_share else rng.randrange(2, 9), rng.choice(reviewers), rng.choice(["s", "s", "t", ""]),
                    action, rng.choice(["Pass", "Fail", "Maybe"]), rng.choice(["", " why ", None])))
    return out


def frame(spark, items):
    return spark.createDataFrame(items, "event_id bigint, s bigint, question_id bigint, reviewer string, session_id string, action string, "
                                 "decision string, notes string").withColumn("at", F.timestamp_micros(F.lit(START) + F.col("s") * 1_000_000)
                                                                             ).select(*lt.ACTIONS.fieldNames())


def by_hand(items):
    """(event id, outcome, reason, micros) of every action and expiry, question by question."""
    out = []
    for question in {x[2] for x in items}:
        lease = Lease()
        for i, s, _, reviewer, session, action, decision, notes in sorted((x for x in items if x[2] == question), key=lambda x: (x[1], x[0])):
            event = lf._EVENT(question, START + s * 1_000_000, i, reviewer, session, action, decision, notes)
            lease, found = advance(question, lease, event)
            out += found
        if lease.expires is not None:
            out.append(expired(question, lease))
    return sorted(((r[0], r[2], r[4], r[5], r[9], r[1] - START, r[10]) for r in out), key=repr)


def got(df):
    found = df.select("question_id", "event_id", "outcome", "reviewer", "reason", F.unix_micros("at") - START, F.unix_micros("lease_expires_at"))
    return sorted(map(tuple, found.collect()), key=repr)


def test_chunks_of_any_size_give_the_same(spark):
    # Busy without a pause; with leases that end in between; one that few reviewers touch.
    cases = [log(500, 0.7, (1, 2, 5), ["A", "B", " A ", "C", "", None]), log(400, 0.7, (60, 600, 1200, 1799, 1800), ["A", "B"], 2),
             log(300, 0.9, (30, 300, 900), [f"r{k}" for k in range(30)], 3, 0.004), log(60, 1.0, (0, 1), ["A", "B"], 4, 0.3)]
    for items, chunk, block in zip(cases, (7, 5, 13, 9), (3, 256, 2, 4)):
        items = [*items, (9000, 5, None, "A", "s", "claim", None, None)]
        want = by_hand(items)
        assert got(lf.fold_leases(frame(spark, items), chunk=chunk, block=block)) == want
        if chunk == 7:
            assert got(lf.fold_leases(frame(spark, items))) == want


def test_a_hot_question_is_walked_by_several_tasks(spark):
    items = log(3000, 2 / 3, (1, 2), ["A", "B", "C"])
    # Small partitions are not put together here, as they would not be at the size that matters.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = lf.fold_leases(frame(spark, items), chunk=100).withColumn("task", F.spark_partition_id())
    counts = tasks.where("question_id = 1").groupBy("task").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(counts) > 2 and max(r["count"] for r in counts) < 0.7 * sum(r["count"] for r in counts)
    assert skew.sessions(frame(spark, items).where("question_id = 1"), "question_id", "at", "30 minutes").count() == 1


def test_leases_that_nobody_touches_are_seen_as_of_a_moment(spark):
    items = [(0, 0, 1, "A", "s", "claim", None, None), (1, 60, 1, "B", "s", "claim", None, None), (2, 10, 2, "A", "s", "claim", None, None)]
    for as_of, want in (("2026-01-01 00:30:05", [(1,)]), ("2026-01-01 00:30:10", [(1,), (2,)]), ("2026-01-01", [])):
        df = lf.fold_leases(frame(spark, items), F.lit(as_of).cast("timestamp"), chunk=2)
        assert rows(df.where("outcome = 'expired'"), "question_id") == want and df.where("event_id is not null").count() == 3


def test_steps_compose_in_any_grouping():
    rng = random.Random(6)
    for _ in range(40):
        events = [lf._EVENT(1, s * 400_000_000, s, rng.choice("AB"), "s", rng.choice(["claim", "renew", "skip", "submit"]), "Pass", "") for s in range(12)]
        a, b = sorted(rng.sample(range(13), 2))
        whole = lf.after([], events)[Lease()]
        first = lf.after([], events[:a])
        second = lf.after(first.values(), events[a:b])
        third = lf.after(second.values(), events[b:])
        assert lf.follow(lf.follow(first[Lease()], second), third) == whole


def test_an_empty_log(spark):
    assert lf.fold_leases(frame(spark, [])).collect() == []
