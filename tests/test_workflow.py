"""Claims, renewals, submissions, bulk failure, resets, deletions, analytics."""

import json

from helpers import moment, question, rec, records, rows, store, ts

from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.operators import analytics as A
from qaloom.operators import decisions as D
from qaloom.operators import leases as L
from qaloom.operators import search as S
from qaloom.plans import state
from qaloom.plans.apply import apply_failures
from qaloom.operators import rules as R

NOON, LATER = "2026-01-01T12:00:00", "2026-01-01T12:30:00"


def claims(spark, *items):
    """(reviewer, session, excluded id) in order."""
    return spark.createDataFrame(
        [(i, *c) for i, c in enumerate(items)],
        "claim_id bigint, reviewer string, session_id string, exclude_question_id bigint")


def requests(spark, *items):
    """(question, reviewer, session, decision, notes, time) in order."""
    return spark.createDataFrame(
        [(i, *r[:5], ts(r[5])) for i, r in enumerate(items)],
        "request_id bigint, question_id bigint, reviewer string, session_id string, decision string,"
        "notes string, requested_at timestamp")


def claim(t, asked, at=NOON, seed="s", batches=None):
    return L.claim(asked, t["questions"], t["reviews"], t["leases"], moment(at), seed, batches)


def test_eight_claimers_one_question(spark):
    t = store(spark, questions=[question(1)])
    changes = claim(t, claims(spark, *[(f"R{i}", f"s{i}", None) for i in range(8)]))
    got = [r.outcome for r in changes["outcomes"].collect()]
    assert sorted(got) == ["claimed"] + ["none"] * 7
    [lease] = changes["leases"].collect()
    assert lease.lease_expires_at.strftime("%H:%M") == "12:30"


def test_no_question_goes_to_two_and_every_question_goes(spark):
    t = store(spark, questions=[question(i) for i in range(40)], leases=[(3, "x", "x", LATER)],
              reviews=[(1, 5, "Pass", "", "x", NOON)])
    got = claim(t, claims(spark, *[(f"R{i}", "s", i % 40) for i in range(60)]))["outcomes"].collect()
    given = [r.question_id for r in got if r.outcome == "claimed"]
    assert len(given) == len(set(given)) == 38 and not {3, 5} & set(given)
    assert all(r.question_id != r.exclude_question_id for r in got)


def test_excluded_questions_in_every_constellation(spark):
    """The only clash takes a spare question, hands on its own, or stays without."""
    one = store(spark, questions=[question(1)])
    got = claim(one, claims(spark, ("A", "a", 1)))["outcomes"].collect()
    assert [(r.question_id, r.outcome) for r in got] == [(None, "none")]
    got = claim(one, claims(spark, ("A", "a", 1), ("B", "b", None)))["outcomes"].collect()
    assert sorted((r.reviewer, r.question_id) for r in got if r.question_id) == [("B", 1)]
    two = store(spark, questions=[question(1), question(2)])
    for seed in "abc":
        got = claim(two, claims(spark, ("A", "a", 1), ("B", "b", 2)), seed=seed)["outcomes"].collect()
        assert {r.reviewer: r.question_id for r in got} == {"A": 2, "B": 1}, seed
        [row] = claim(two, claims(spark, ("A", "a", 1)), seed=seed)["outcomes"].collect()
        assert row.question_id == 2


def test_resume_refusal_and_expiry(spark):
    t = store(spark, questions=[question(1), question(2), question(3)],
              leases=[(1, "Amina", "a", LATER), (2, "Old", "o", NOON), (3, "Done", "d", LATER)],
              reviews=[(9, 3, "Pass", "", "Done", NOON)])
    changes = claim(t, claims(
        spark, (" Amina ", "a", 1), ("Amina", "a", None), ("  ", "x", None), ("Y", "", None), ("Old", "o", None)))
    got = {(r.reviewer, r.session_id): (r.question_id, r.outcome) for r in changes["outcomes"].collect()}
    assert got == {("Amina", "a"): (1, "resumed"), ("", "x"): (None, "refused"), ("Y", ""): (None, "refused"),
                   ("Old", "o"): (2, "claimed")}
    assert rows(changes["audit"], "event_type", "question_id", "actor") == [("lease_expired", 2, "Old")]
    after = state.after_claim(t, changes)
    assert rows(after["leases"], "question_id", "reviewer") == [(1, "Amina"), (2, "Old"), (3, "Done")]
    ready = claim(t, claims(spark, ("New", "n", None)), batches=store(spark, batches=[(1, "uploading")])["batches"])
    assert [r.outcome for r in ready["outcomes"].collect()] == ["none"]


def test_renewal_and_inactivity(spark):
    """Claim at 0, renewed at 20, still held at 40, free again at 51 minutes."""
    t = store(spark, questions=[question(1)])
    t = state.after_claim(t, claim(t, claims(spark, ("Amina", "a", None)), "2026-01-01T00:00:00"))
    asked = requests(spark, (1, "Amina ", "a", "", "", NOON), (1, "Bader", "b", "", "", NOON))
    changes = L.renew(asked, t["leases"], moment("2026-01-01T00:20:00"))
    assert rows(changes["outcomes"], "request_id", "renewed") == [(0, True), (1, False)]
    t = state.after_renew(t, changes)
    bader = claims(spark, ("Bader", "b", None))
    assert [r.outcome for r in claim(t, bader, "2026-01-01T00:40:00")["outcomes"].collect()] == ["none"]
    got = claim(t, bader, "2026-01-01T00:51:00")["outcomes"].collect()
    assert [(r.question_id, r.outcome) for r in got] == [(1, "claimed")]
    assert L.renew(asked, t["leases"], moment("2026-01-01T00:50:00"))["leases"].count() == 0


def test_skip(spark):
    t = store(spark, questions=[question(1), question(2)],
              leases=[(1, "Amina", "a", "2025-01-01T00:00:00"), (2, "Bader", "b", LATER)])
    asked = requests(spark, (1, "Amina", "a", "", "", NOON), (1, "Amina", "a", "", "", NOON),
                     (2, "Bader", "other", "", "", NOON))
    changes = L.skip(asked, t["leases"], moment(NOON))
    assert rows(changes["outcomes"], "request_id", "reason") == [(0, None), (1, L.INACTIVE), (2, L.INACTIVE)]
    after = state.after_skip(t, changes)
    assert rows(after["leases"], "question_id") == [(2,)]
    assert rows(after["audit"], "event_type", "question_id", "actor") == [("skip", 1, "Amina")]
    assert "audit" not in L.skip(asked, t["leases"], moment(NOON), with_audit=False)


def test_submit(spark):
    t = store(spark, questions=[question(i) for i in range(1, 5)],
              leases=[(i, "Amina", "a", LATER) for i in (1, 2, 4)], reviews=[(7, 4, "Pass", "", "x", NOON)])
    asked = requests(
        spark,
        (1, "Amina", "a", "Fail", "  ", "2026-01-01T12:01:00"),
        (1, "Amina", "a", "Maybe", "x", "2026-01-01T12:02:00"),
        (1, "Bader", "b", "Pass", "", "2026-01-01T12:03:00"),
        (1, " Amina ", "a", "Fail", " unsupported\n", "2026-01-01T12:04:00"),
        (1, "Amina", "a", "Pass", "", "2026-01-01T12:05:00"),
        (1, "Bader", "b", "Pass", "", "2026-01-01T12:06:00"),
        (2, "Amina", "a", "Pass", "dropped", LATER),
        (3, "Amina", "a", "Pass", "", NOON),
        (4, "Amina", "a", "Pass", "", NOON),
        (2, "Amina", "a", "Pass", "dropped", "2026-01-01T12:29:59"),
    )
    changes = D.submit(asked, t["reviews"], t["leases"])
    reasons = [r.reason for r in changes["outcomes"].orderBy("request_id").collect()]
    assert reasons == [D.NOTES_REQUIRED, D.BAD_DECISION, L.INACTIVE, None, D.REVIEWED, D.REVIEWED,
                       D.REVIEWED, L.INACTIVE, D.REVIEWED, None]
    assert rows(changes["reviews"], "question_id", "decision", "notes", "reviewer") == [
        (1, "Fail", "unsupported", "Amina"), (2, "Pass", "", "Amina")]
    hosted = D.submit(asked, t["reviews"], t["leases"], lease_first=True)["outcomes"]
    reasons = [r.reason for r in hosted.orderBy("request_id").collect()]
    assert reasons[4:7] == [L.INACTIVE, L.INACTIVE, L.INACTIVE] and reasons[8] == D.REVIEWED
    after = state.after_submit(t, changes)
    assert rows(after["leases"], "question_id") == [(4,)]
    ids = [r.id for r in after["reviews"].collect()]
    assert len(set(ids)) == 3 and sorted(ids)[0] == 7


def item(spark, *items):
    """(source id, output, notes) in order."""
    df = spark.createDataFrame(list(enumerate(items)), "ord bigint, i struct<source_id string, output string, notes string>")
    digest = tx.row_hash(F.lit("لخص"), F.array(F.lit("نص")), F.col("i.output"))
    return df.select("ord", "i.source_id", "i.notes", digest.alias("row_hash"))


def bulk(spark, t, items):
    return D.bulk_fail(items, t["questions"], t["reviews"], F.lit("أحمد"), moment(NOON))


def test_bulk_fail_in_every_state(spark):
    t = store(
        spark,
        questions=[question(1, "new"), question(2, "failed"), question(3, "passed"), question(4, "leased"),
                   question(5, "changed"), question(6, "twice"), question(7, "twice", 2, output="آخر"),
                   question(8, "both"), question(9, "both", 2)],
        leases=[(4, "محمد", "s", "2099-01-01T00:00:00"), (2, "x", "x", LATER)],
        reviews=[(20, 2, "Fail", "ملاحظة", "محمد", NOON), (30, 3, "Pass", "", "محمد", NOON)])
    items = item(spark, ("new", "ملخص", "first"), ("new", "ملخص", "last"), ("failed", "ملخص", "n"),
                 ("passed", "ملخص", "سؤال مكرر"), ("leased", "ملخص", "n"), ("changed", "مختلف", "n"),
                 ("twice", "ملخص", "n"), ("both", "ملخص", "n"), ("absent", "ملخص", "n"))
    changes = bulk(spark, t, items)
    assert rows(changes["actions"], "question_id", "action") == [
        (1, "failed"), (2, "already_failed"), (3, "overwritten"), (4, "failed"), (6, "failed"),
        (8, "failed"), (9, "failed")]
    assert D.bulk_fail_summary(changes).collect() == [(5, 1, 1, 2)]
    assert rows(changes["unmatched"], "source_id") == [("absent",), ("changed",)]
    after = state.after_bulk_fail(t, changes)
    found = {r.question_id: r for r in after["reviews"].collect()}
    assert (found[1].notes, found[1].reviewer) == ("last", A.AUTOMATIC_REVIEWER)
    assert (found[2].notes, found[2].reviewer) == ("ملاحظة", "محمد")
    assert (found[3].id, found[3].decision, found[3].notes, found[3].reviewer) == (
        30, "Fail", "سؤال مكرر", A.AUTOMATIC_REVIEWER)
    assert len({r.id for r in found.values()}) == len(found)
    assert rows(after["leases"], "question_id") == [(2,)]
    audit = {r.question_id: r for r in after["audit"].collect()}
    assert {q: r.event_type for q, r in audit.items()} == {
        1: "auto_fail", 3: "review_overridden", 4: "auto_fail", 6: "auto_fail", 8: "auto_fail", 9: "auto_fail"}
    details = json.loads(audit[3].details_json)
    assert (details["decision"], details["reviewer"], details["replaced_with"]) == ("Pass", "محمد", "سؤال مكرر")
    assert audit[3].actor == "أحمد" and audit[3].review_id == 30
    again = bulk(spark, after, items)
    assert D.bulk_fail_summary(again).collect() == [(0, 0, 7, 2)]
    assert again["audit"].count() == 0 and again["dropped_leases"].count() == 0


def test_bulk_fail_of_many_and_of_none(spark):
    t = store(spark, questions=[question(i, str(i), output=f"مخرج {i}") for i in range(120)])
    many = item(spark, *[(str(i), f"مخرج {i}", "n") for i in range(120)])
    assert D.bulk_fail_summary(bulk(spark, t, many)).collect() == [(120, 0, 0, 0)]
    assert D.bulk_fail_summary(bulk(spark, t, many.where("false"))).collect() == [(0, 0, 0, 0)]


def test_checks_flow_into_the_store(spark):
    """What the checker fails is failed in the store, found by id and content."""
    found = R.failure_rows(R.judge(records(
        spark, rec(parts=["a"], output="ok", source_id="1"), rec(parts=["b"], output="تمام", source_id="2")), "arabizi"))
    t = store(spark, questions=[question(1, "1", parts=["a"], output="ok"), question(2, "2", parts=["b"], output="تمام")])
    after, changes = apply_failures(found, t, F.lit("admin"), moment(NOON))
    assert rows(after["reviews"], "question_id", "notes") == [(1, R.NOTES["english"])]
    assert changes["summary"].collect() == [(1, 0, 0, 0)]


def test_reset(spark):
    t = store(spark, questions=[question(1)], reviews=[(5, 1, "Fail", "unsupported", "Amina", NOON)])
    asked = spark.createDataFrame([(0, 5, "admin"), (1, 5, "admin"), (2, 6, "admin")],
                                  "request_id bigint, review_id bigint, actor string")
    changes = D.reset(asked, t["reviews"], moment(NOON))
    assert rows(changes["outcomes"], "request_id", "reason") == [(0, None), (1, D.NO_REVIEW), (2, D.NO_REVIEW)]
    after = state.after_reset(t, changes)
    assert after["reviews"].count() == 0
    [event] = after["audit"].collect()
    assert event.event_type == "review_reset" and event.review_id == 5
    assert json.loads(event.details_json)["notes"] == "unsupported"
    again = claim(after, claims(spark, ("Bader", "b", None)))["outcomes"].collect()
    assert [r.question_id for r in again] == [1]


def test_delete_batches(spark):
    t = store(spark, batches=[(1, "ready"), (2, "uploading"), (3, "ready")],
              questions=[question(1, batch=1), question(2, batch=2), question(3, batch=2)],
              leases=[(2, "x", "x", LATER), (1, "y", "y", LATER)], reviews=[(5, 1, "Pass", "", "x", NOON)])
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (2,)], "batch_id bigint")
    changes = D.delete_batches(asked, t["batches"], t["questions"], t["reviews"], t["leases"],
                               F.lit("admin"), moment(NOON))
    assert rows(changes["outcomes"], "batch_id", "stored", "reason") == [
        (1, 1, "1" + D.HAS_REVIEWS), (2, 2, None), (3, 0, None), (4, 0, D.NO_UPLOAD)]
    after = state.after_delete(t, changes)
    assert rows(after["batches"], "id") == [(1,)] and rows(after["questions"], "id") == [(1,)]
    assert rows(after["leases"], "question_id") == [(1,)]
    details = [json.loads(r.details_json) for r in after["audit"].collect()]
    assert sorted((d["id"], d["deleted_questions"]) for d in details) == [(2, 2), (3, 0)]


def test_analytics(spark):
    t = store(spark, batches=[(1, "ready"), (2, "uploading")],
              questions=[question(1), question(2), question(3), question(4, batch=2)],
              leases=[(2, "Bader", "b", LATER), (3, "Old", "o", NOON), (1, "Amina", "a", LATER)],
              reviews=[(1, 1, "Pass", "", "Amina", NOON)])
    parts = t["questions"], t["reviews"], t["leases"], moment(NOON)
    one = A.progress(A.question_state(*parts, batch_id=1)).first()
    assert (one.total, one.reviewed, one.assigned, one.pending, one.passed, one.failed, one.pass_rate) == (
        3, 1, 1, 1, 1, 0, 100.0)
    ready = A.progress(A.question_state(*parts, batches=t["batches"])).first()
    assert ready.total == 3 and A.progress(A.question_state(*parts)).first().total == 4
    none = A.progress(A.question_state(*parts, batch_id=9)).first()
    assert tuple(none) == (0, 0, 0, 0, 0, 0, 0.0, 0.0)
    assert rows(A.share_of_max(A.by_reviewer(t["reviews"])), "reviewer", "percent") == [("Amina", 100.0)]
    listed = A.batch_list(t["batches"], t["questions"], t["reviews"])
    assert [(r.id, r.stored, r.reviewed) for r in listed.collect()] == [(2, 1, 0), (1, 3, 1)]
    assert A.held_back(listed).collect() == [(1, 1)]


def test_pass_rate_rounds_halves_to_even(spark):
    pairs = [(p, n) for n in range(0, 200) for p in range(0, n + 1)]
    df = spark.createDataFrame(pairs, "p bigint, n bigint").withColumn("r", A.pass_rate(F.col("p"), F.col("n")))
    assert all(r.r == (round(r.p / r.n * 100, 1) if r.n else 0.0) for r in df.collect())


def test_search_and_export(spark):
    t = store(spark, batches=[(1, "ready"), (2, "ready")],
              questions=[question(1, parts=["Line one", "Line two"]), question(2, "x%y", batch=2, output="a\\b"),
                         question(3)],
              reviews=[(1, 1, "Pass", "", "Amina", NOON), (2, 2, "Fail", "É unsupported", "Bader", LATER)])
    def found(term, **more):
        return [r.review_id for r in S.search_reviews(
            t["reviews"], t["questions"], t["batches"], term, **more).collect()]

    assert found("") == [2, 1] and found("  UNSUPPORTED ") == [2] and found("", limit=0) == [2]
    assert found("é unsup") == [] and found("É unsup") == [2]
    assert found("a\\b") == [2] and found("line_one") == [1] and found("x%y") == [2] and found("n%two") == [1]
    assert found('one", "line') == [1] and found("f2.json") == [2] and found("F2xjson") == []
    assert found("", batch_id=1) == [1]
    hosted = S.search_reviews_by_id(t["reviews"], t["questions"], "f2.json")
    assert hosted.count() == 0
    assert S.with_decision(S.search_reviews(t["reviews"], t["questions"], t["batches"]), "Fail").count() == 1
    export = S.export_rows(t["reviews"], t["questions"])
    assert export.columns == ["instruction", "question", "output", "pass/fail", "notes"]
    assert [tuple(r)[1:4] for r in export.collect()] == [
        ("Line one\nLine two", "ملخص", "Pass"), ("نص", "a\\b", "Fail")]
    assert S.export_rows(t["reviews"], t["questions"], batch_id=2).count() == 1


def test_versions_of_the_tables(spark, tmp_path):
    t = store(spark, questions=[question(1)])
    state.save(t, str(tmp_path), 1)
    state.save({**t, "questions": t["questions"].where("false")}, str(tmp_path), 2)
    assert state.load(spark, str(tmp_path))["questions"].count() == 0


def test_every_claim_is_answered(spark):
    t = store(spark, batches=[(1, "ready")], questions=[question(k) for k in range(1, 4)])
    asked = claims(spark, ("Cem", "c", None), (" Cem", "c", 2), ("Dora", "d", None), ("Cem", "c", None), ("", "x", None), ("", "x", 1), ("Eli", "", None), ("Cem", "other", None))
    changes = claim(t, asked)
    got = {r.claim_id: (r.outcome, r.question_id) for r in changes["outcomes"].collect()}
    assert len(got) == 8 and changes["leases"].count() == 3
    assert [got[k][0] for k in (0, 1, 2, 3, 4, 5, 6, 7)] == ["claimed", "resumed", "claimed", "resumed", "refused", "refused", "refused", "claimed"]
    assert got[0][1] == got[1][1] == got[3][1] and len({got[k][1] for k in (0, 2, 7)}) == 3
