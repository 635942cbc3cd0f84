"""Streams: leases over several arrivals, live counts, arriving records."""

import json

from helpers import rec, records, rows, ts
from pyspark.sql import functions as F

from qaloom.catalog import views as V
from qaloom.operators.decisions import NOTES_REQUIRED, REVIEWED
from qaloom.operators.leases import INACTIVE, WHO_REQUIRED
from qaloom.schema import RECORDS, REVIEWS
from qaloom.sources.imports import NOT_OPEN
from qaloom.streaming import ingest, live
from qaloom.streaming import lease_tracker as lt
from qaloom.streaming.lease_fold import fold_leases

SHOWN = ["question_id", "at", "event_id", "action", "outcome", "reviewer", "notes", "reason", "lease_expires_at"]


def actions(spark, *items):
    """(minute, question, reviewer, action, decision, notes) in order."""
    return spark.createDataFrame(
        [(i, ts(f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00"), q, r, "s", a, d, n)
         for i, (m, q, r, a, d, n) in enumerate(items)], lt.ACTIONS)


def test_the_rules_of_a_lease(spark):
    log = actions(
        spark,
        (0, 1, " Amina ", "claim", None, None), (20, 1, "Amina", "renew", None, None),
        (40, 1, "Bader", "claim", None, None), (50, 1, "Bader", "claim", None, None),
        (51, 1, "Amina", "submit", "Pass", ""), (52, 1, "Bader", "submit", "Fail", " "),
        (53, 1, "Bader", "submit", "Fail", " why "), (54, 1, "Bader", "submit", "Pass", None),
        (55, 1, "Amina", "claim", None, None), (300, 1, "Amina", "submit", "Pass", None),
        (301, 1, "Amina", "claim", None, None), (302, 1, "Amina", "skip", None, None),
        (0, 2, "Amina", "claim", None, None), (1, 2, "Amina", "skip", None, None),
        (2, 2, "Bader", "claim", None, None), (3, 2, "", "claim", None, None), (4, 2, "Bader", "claim", None, None),
    )
    got = fold_leases(log).orderBy("question_id", "at", "event_id").collect()
    assert [(r.outcome, r.reason) for r in got if r.question_id == 1] == [
        ("claimed", None), ("renewed", None), ("none", None), ("expired", None), ("claimed", None),
        ("refused", INACTIVE), ("refused", NOTES_REQUIRED), ("submitted", None), ("refused", REVIEWED),
        ("none", None), ("refused", REVIEWED), ("none", None), ("refused", INACTIVE)]
    assert [(r.outcome, r.reason) for r in got if r.question_id == 2] == [
        ("claimed", None), ("skipped", None), ("claimed", None), ("refused", WHO_REQUIRED), ("resumed", None),
        ("expired", None)]
    assert [r.notes for r in got if r.outcome == "submitted"] == ["why"]


def lease_log(spark):
    """The actions of the test tables, 20 seconds apart."""
    log = V.lease_events(spark, "/root/testdata/sf0.001").withColumn(
        "at", F.timestamp_seconds(F.unix_timestamp("at") + F.col("event_id") * 20)).select(*lt.ACTIONS.fieldNames())
    return log.cache()


def arrive(spark, log, tmp_path, delay="1 minute", finish=False):
    log.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lt.ACTIONS).parquet(f"{tmp_path}/in")
    lt.run_tracker(stream, f"{tmp_path}/out", f"{tmp_path}/state", delay, finish).awaitTermination()
    return lt.read_outcomes(spark, f"{tmp_path}/out")


def test_the_stream_agrees_with_the_fold_over_several_arrivals(spark, tmp_path):
    log = lease_log(spark)
    for i in range(3):
        got = arrive(spark, log.where(f"event_id div 400 = {i}"), tmp_path, finish=i == 2)
    assert {r.table for r in got.select("table").distinct().collect()} == set(lt.TABLES)
    want = fold_leases(log, log.select(F.max("at")).scalar())
    assert want.where("outcome = 'expired'").count() > 20
    assert rows(got, *SHOWN) == rows(want, *SHOWN)


def test_arrivals_out_of_order_give_the_rows_of_the_fold(spark, tmp_path):
    """Odd and even actions arrive apart; all are within the delay of the newest."""
    log = lease_log(spark)
    span = log.select((F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at")) + 60).alias("s")).first().s
    for i in (1, 0):
        got = arrive(spark, log.where(f"event_id % 2 = {i}"), tmp_path, f"{span} seconds", finish=i == 0)
    want = fold_leases(log, log.select(F.max("at")).scalar())
    assert rows(got, *SHOWN) == rows(want, *SHOWN)


def test_late_actions_are_refused_and_every_action_has_a_row(spark, tmp_path):
    log = lease_log(spark)
    second = F.col("event_id").between(400, 700) | (F.col("event_id") % 50 == 3)
    arrive(spark, log.where(~second), tmp_path)
    got = arrive(spark, log.where(second), tmp_path, finish=True)
    ids = [r.event_id for r in got.where("event_id is not null").select("event_id").collect()]
    assert sorted(ids) == sorted(r.event_id for r in log.collect())
    late = got.where("outcome = 'late'")
    assert {r.table for r in late.collect()} == {"refused"} and rows(late.select("reason").distinct(), "reason") == [(lt.LATE,)]
    newest = log.where(~second).select(F.max("at")).scalar()
    expected = log.where(second & (F.col("at") <= newest - F.expr("interval 1 minute")))
    assert rows(late, "event_id") == rows(expected, "event_id") != []
    # The others are judged as if the late ones were not there.
    want = fold_leases(log.join(expected, "event_id", "left_anti").select(*lt.ACTIONS.fieldNames()), log.select(F.max("at")).scalar())
    assert rows(got.where("outcome <> 'late'"), *SHOWN) == rows(want, *SHOWN)


def test_actions_wait_until_their_time_is_closed(spark, tmp_path):
    first = actions(spark, (10, 1, "Amina", "submit", "Pass", ""), (12, 2, "Bader", "claim", None, None))
    got = arrive(spark, first, tmp_path, "5 minutes")
    assert got.count() == 0
    late = actions(spark, (9, 1, "Amina", "claim", None, None), (6, 2, "Bader", "skip", None, None), (60, 3, "", "skip", None, None))
    late = late.withColumn("event_id", F.col("event_id") + 10).unionByName(
        late.limit(1).withColumns({"at": F.lit(None).cast("timestamp"), "event_id": F.lit(99).cast("bigint")}))
    got = arrive(spark, late, tmp_path, "5 minutes")
    assert rows(got, "event_id", "outcome") == sorted(
        [(10, "claimed"), (0, "submitted"), (1, "claimed"), (None, "expired"), (11, "late"), (99, "late")], key=repr)
    got = arrive(spark, first.limit(0), tmp_path, "5 minutes", finish=True)
    assert rows(got.where("event_id = 12"), "outcome", "reason") == [("refused", INACTIVE)]
    again = arrive(spark, first.withColumn("event_id", F.col("event_id") + 20), tmp_path, "5 minutes", finish=True)
    assert rows(again.where("event_id >= 20 and event_id < 90"), "outcome") == [("late",), ("late",)] and again.count() == 9


def test_a_question_has_one_state_and_one_timer_for_all_its_actions(spark, tmp_path):
    """400 actions on four questions: state is written for each question, not for each action."""
    log = actions(spark, *[(i, i % 4, f"r{i % 3}", ["claim", "renew", "skip"][i % 7 % 3], None, None) for i in range(400)])
    log.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lt.ACTIONS).parquet(f"{tmp_path}/in")
    query = lt.run_tracker(stream, f"{tmp_path}/out", f"{tmp_path}/state", finish=True)
    query.awaitTermination()
    held = [p["stateOperators"][0] for p in query.recentProgress]
    assert max(x["numRowsUpdated"] for x in held) <= 4 and max(x["customMetrics"].get("numRegisteredTimers", 0) for x in held) <= 4
    want = fold_leases(log, log.select(F.max("at")).scalar())
    assert rows(lt.read_outcomes(spark, f"{tmp_path}/out"), *SHOWN) == rows(want, *SHOWN)


def test_many_waiting_actions_are_judged_slot_by_slot(spark, tmp_path):
    """One question with two thirds of the actions, three of which may wait beside its lease; arrivals overlap."""
    log = actions(spark, *[(i, 1 if i % 3 else 2 + i % 4, f"r{i % 5}", ["claim", "claim", "renew", "skip", "submit"][i % 11 % 5],
                            "Pass" if i % 13 == 12 else None, None) for i in range(300)])
    for i, arriving in enumerate((F.col("event_id") % 2 == 0, F.col("event_id") % 4 == 1, F.col("event_id") % 4 == 3)):
        log.where(arriving).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(lt.ACTIONS).parquet(f"{tmp_path}/in")
        lt.run_tracker(stream, f"{tmp_path}/out", f"{tmp_path}/state", "200 minutes", i == 2, few=3, slot=7 * 60_000).awaitTermination()
        if i == 0:
            # Part of a slot has been judged.
            assert 0 < lt.read_outcomes(spark, f"{tmp_path}/out").where("event_id is not null").count() < 100
    got = lt.read_outcomes(spark, f"{tmp_path}/out")
    late = log.where("event_id % 2 = 1 and event_id <= 98")
    want = fold_leases(log.join(late, "event_id", "left_anti").select(*lt.ACTIONS.fieldNames()), log.select(F.max("at")).scalar())
    assert rows(got.where("outcome = 'late'"), "event_id") == rows(late, "event_id")
    assert rows(got.where("outcome <> 'late'"), *SHOWN) == rows(want, *SHOWN)


def test_actions_of_one_moment_are_judged_in_order_of_their_ids(spark, tmp_path):
    """Several actions of a question in one millisecond, also in two arrivals, and one row twice."""
    log = actions(spark, *[(i // 4, i // 4 % 2, f"r{i % 3}", ["claim", "skip", "renew"][i % 5 % 3], None, None) for i in range(40)])
    log = log.unionByName(log.where("event_id = 5"))
    for i in (1, 0):
        got = arrive(spark, log.where(f"event_id % 2 = {i}"), tmp_path, "60 minutes", finish=i == 0)
    want = fold_leases(log, log.select(F.max("at")).scalar())
    assert rows(got, *SHOWN) == rows(want, *SHOWN) and got.where("event_id = 5").count() == 2


def test_live_counts_follow_arrivals(spark, tmp_path):
    days = ["2026-01-01", "2026-01-01", "2026-01-02"]
    for i, day in enumerate(days):
        spark.createDataFrame([(i, i, "Pass", "", "Amina" if i else "Bader", ts(f"{day}T0{i}:00:00"))], REVIEWS
                              ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(REVIEWS).parquet(f"{tmp_path}/in")
        for name, counts in ("who", live.reviewer_counts), ("day", live.daily_counts):
            live.keep_latest(counts(stream), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
    who = live.latest(spark, f"{tmp_path}/who", "reviewer")
    assert rows(who, "reviewer", "reviews") == [("Amina", 2), ("Bader", 1)]
    assert rows(live.latest(spark, f"{tmp_path}/day", "date"), "date", "reviews") == [
        ("2026-01-01", 2), ("2026-01-02", 1)]


def test_repeats_across_arrivals(spark, tmp_path):
    arrivals = [[rec(parts=["a"]), rec(parts=["b"])], [rec(parts=["c"]), rec(parts=["a"]), rec(parts=["c"])],
                [rec(parts=["c"]), rec(parts=["d"])]]
    for i, cases in enumerate(arrivals):
        part = records(spark, *cases).withColumn("position", F.col("position") + 10 * i)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(RECORDS).parquet(f"{tmp_path}/in")
        ingest.mark_arriving(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    marked = ingest.marked(spark, f"{tmp_path}/out")
    assert rows(marked.where("is_repeat"), "position") == [(11,), (12,), (20,)] and marked.count() == 7


def test_an_arrival_meets_only_its_own_keys_and_no_text(spark, tmp_path):
    """The ninth arrival repeats one record of the first: state has all keys, but one row of a key arrives however common it is."""
    for i in range(9):
        cases = [rec(parts=[f"{i} {k}"]) for k in range(20)] + [rec(parts=["common"])] * 30 + [rec(parts=["0 3"])] * (i == 8)
        records(spark, *cases).withColumn("position", F.col("position") + 100 * i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(RECORDS).parquet(f"{tmp_path}/in")
        query = ingest.mark_arriving(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
    (progress,) = [p for p in query.recentProgress if p["numInputRows"]]
    assert progress["numInputRows"] == 22 and progress["stateOperators"][0]["numRowsUpdated"] <= 22
    marked = ingest.marked(spark, f"{tmp_path}/out")
    assert marked.count() == 9 * 50 + 1
    assert rows(marked.where("is_repeat"), "position") == sorted([*[(100 * i + k,) for i in range(9) for k in range(20, 50) if i or k > 20], (850,)], key=repr)
    held = spark.read.parquet(f"{tmp_path}/state/arrived/batch-8")
    assert set(held.columns) <= {"key", "position", "source_id", "arrival", "is_repeat"}


def uploads(*states):
    return lambda spark: spark.createDataFrame(list(states), "id bigint, status string")


def test_chunks_are_stored_and_refused(spark, tmp_path):
    good = json.dumps({"id": 1, "instruction": "i", "input": "q", "output": "o"})
    schema = "batch_id bigint, row bigint, line string"
    for i, lines in enumerate([[good, "{}"], [good, good, "[broken"]]):
        df = spark.createDataFrame([(7, 10 * i + j, t) for j, t in enumerate(lines)], schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.ingest_chunks(stream, uploads((7, "uploading")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/out/questions")
    assert rows(stored, "batch_id", "row", "source_id", "input") == [
        (7, 0, "1", ["q"]), (7, 10, "1", ["q"]), (7, 11, "1", ["q"])]
    assert rows(spark.read.parquet(f"{tmp_path}/out/refused"), "row") == [(1,), (12,)]
    assert rows(spark.read.parquet(f"{tmp_path}/out/chunks"), "batch", "imported", "skipped") == [(0, 1, 1), (1, 2, 1)]
    assert rows(ingest.counts(spark, f"{tmp_path}/out"), "*") == [(7, 3, 2, 0)]


def test_the_status_is_asked_for_each_arrival_and_kept_with_it(spark, tmp_path):
    good = json.dumps({"id": 1, "instruction": "i", "input": "q", "output": "o"})
    schema = "batch_id bigint, row bigint, line string"
    seen = [[(1, "uploading"), (2, "ready")], [(1, "ready"), (2, "uploading")], []]
    for i, states in enumerate(seen):
        df = spark.createDataFrame([(b, i, t) for b in (1, 2, 3) for t in (good, "{}")], schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.ingest_chunks(stream, uploads(*states), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = [(1, 1, 1, 4), (2, 1, 1, 4), (3, 0, 0, 6)]
    assert rows(ingest.counts(spark, f"{tmp_path}/out"), "*") == want
    refused = spark.read.parquet(f"{tmp_path}/out/refused")
    assert refused.where(F.col("refusal") == NOT_OPEN).count() == 14 and refused.where("batch_id = 3").count() == 6
    # The last micro-batch runs once more, as after a crash before its end was noted; by now every upload is open.
    for name in (tmp_path / "state" / "commits").iterdir():
        if name.name.strip(".").startswith("2"):
            name.unlink()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    ingest.ingest_chunks(stream, uploads((1, "uploading"), (2, "uploading"), (3, "uploading")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(ingest.counts(spark, f"{tmp_path}/out"), "*") == want


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from qaloom.catalog.queries import QUERIES

    source = "/root/testdata/sf0.001"
    for name in ("events", "documents", "labels"):
        spark.read.parquet(f"{source}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("lease_stream", "live_by_reviewer", "live_over_time", "incremental_ingest", "incremental_duplicates"):
        whole, parts = QUERIES[name](spark, source), QUERIES[name](spark, str(tmp_path))
        assert rows(whole, *whole.columns) == rows(parts, *whole.columns) != []


def test_days_are_complete_whatever_the_order_of_arrival(spark, tmp_path):
    days = ["2024-01-10", "2024-01-05", "2024-01-10", "2024-02-01", "2024-01-05"]
    for n, day in enumerate(days):
        spark.createDataFrame([(n, n, "Pass", "", "r", ts(day))], REVIEWS).write.mode("append").parquet(f"{tmp_path}/in")
        counts = live.daily_counts(spark.readStream.schema(REVIEWS).parquet(f"{tmp_path}/in"))
        live.keep_latest(counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(live.latest(spark, f"{tmp_path}/out", "date"), "date", "reviews") == [
        ("2024-01-05", 2), ("2024-01-10", 2), ("2024-02-01", 1)]
