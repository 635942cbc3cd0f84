"""One key holding a third of the rows or more; plans that must stay as they are."""

import pytest
from pyspark.sql import functions as F

from qaloom.catalog import views as V
from qaloom.operators import rules as R
from qaloom.operators import skew

SF = "/root/testdata/sf0.001"


def hot(spark, n=60_000):
    """Two thirds of the rows share one key."""
    key = F.when(F.col("id") % 3 < 2, -1).otherwise(F.col("id"))
    return spark.range(n).select("id", key.alias("k"), F.repeat(F.lit("x"), 200).alias("pad"))


@pytest.fixture
def small_skew(spark):
    """Thresholds at which the test data counts as skewed, and no broadcast."""
    values = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in values.items():
        spark.conf.set(name, value)
    yield
    for name in values:
        spark.conf.unset(name)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeats_of_a_hot_key_are_split(spark, small_skew):
    df = skew.mark_repeats(hot(spark).repartition(16), ["k"], F.col("id"))
    assert df.where("is_repeat").count() == 39_999
    assert "skew=true" in final_plan(df)


def test_lookup_of_a_hot_key_is_split(spark, small_skew):
    names = hot(spark).groupBy("k").agg(F.min("id").alias("first"))
    df = skew.join_unique(hot(spark).repartition(16), names, ["k"])
    assert df.where("first is null").count() == 0 and df.count() == 60_000
    assert "skew=true" in final_plan(df)


def test_hash_rank_is_the_rank_of_one_big_sort(spark):
    df = spark.range(5000).withColumn("d", F.sha2(F.col("id").cast("string"), 256))
    want = [r.id for r in df.orderBy("d").collect()]
    got = skew.hash_rank(df, "d", "rank").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 5001)) and [r.id for r in got] == want
    top = skew.hash_rank(df, "d", "rank", first=F.lit(17)).orderBy("rank").collect()
    assert [r.id for r in top] == want[:17]


def test_sessions_meet_across_hours_and_end_at_exactly_the_gap(spark):
    minutes = [0, 29, 58, 61, 90, 120, 149, 179, 300]
    df = spark.createDataFrame([(1, m) for m in minutes] + [(2, 5)], "k int, m int").select(
        "k", F.timestamp_seconds(F.col("m") * 60).alias("at"))
    got = skew.sessions(df, "k", "at", "30 minutes").orderBy("k", "session_no").collect()
    assert [(r.k, r.session_no, r.events) for r in got] == [(1, 1, 5), (1, 2, 2), (1, 3, 1), (1, 4, 1), (2, 1, 1)]
    rows = skew.with_sessions(df, "k", "at", "30 minutes").where("k = 1").orderBy("at").collect()
    assert [r.session_no for r in rows] == [1, 1, 1, 1, 1, 2, 2, 3, 4]


def test_a_hot_key_is_counted_before_its_runs_are_put_in_order(spark):
    """Two thirds of the rows on one key: what reaches the window is one row per half gap."""
    df = hot(spark).select("k", F.timestamp_seconds(F.col("id") % 20_000).alias("at"))
    runs = skew.sessions(df, "k", "at", "30 minutes")
    plan = runs._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "partial_min" in below and "partial_count" in below
    assert skew._cells(df, "k", "at", "30 minutes").where("k = -1").count() == 23
    (one,) = runs.where("k = -1").collect()
    assert (one.session_no, one.events) == (1, 40_000)


def test_runs_against_a_walk_of_all_rows(spark):
    import random

    rng = random.Random(4)
    moments = [(rng.randrange(5), rng.choice([1800, 1799, 1801, 900, 60, 0]) * rng.randrange(40) - 20_000) for _ in range(400)]
    df = spark.createDataFrame(moments + [(3, None)], "k int, s long").select("k", F.timestamp_seconds("s").alias("at"), "s")
    want = {}
    for key in range(5):
        last, number = None, 1 if key == 3 else 0
        for s in sorted(s for k, s in moments if k == key):
            number += last is None or s - last >= 1800
            last, want[key, s] = s, number
    want[3, None] = 1
    got = {(r.k, r.s): r.session_no for r in skew.with_sessions(df, "k", "at", "30 minutes").collect()}
    assert got == want


def test_no_text_is_shuffled_for_repeats(spark):
    """The aggregate that finds repeats carries digests and positions only."""
    text = R.mark_duplicates(V.question_records(spark, SF)).where("is_repeat").select("position")
    shuffles = [p for p in text._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in p]
    assert shuffles and all("text" not in p and "output" not in p for p in shuffles)


def test_rules_run_once_under_a_filter_on_their_outcome(spark):
    failures = R.failure_rows(R.judge(V.records(spark, SF), "arabizi"))
    assert failures._jdf.queryExecution().executedPlan().toString().count("IsLatin") == 1
    unchecked = R.unchecked_rows(R.judge(V.tool_records(spark, SF), "tool_calling"))
    assert unchecked._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2


def test_intermediate_tables_can_be_cleared(spark):
    from pathlib import Path

    from qaloom import session

    kept = session.cut(spark.range(5))
    folder = Path(session._cuts(spark).removeprefix("file:"))
    assert kept.count() == 5 and any(folder.iterdir())
    session.clear_cuts(spark)
    assert not folder.exists() and session.cut(spark.range(3)).count() == 3
