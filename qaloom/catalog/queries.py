"""Registered queries: operators over the views of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.catalog import views as V
from qaloom.functions import text as tx
from qaloom.functions import tools as tl
from qaloom.operators import analytics as A
from qaloom.operators import audit
from qaloom.operators import decisions as D
from qaloom.operators import leases as L
from qaloom.operators import rules as R
from qaloom.operators import search as S
from qaloom.operators import skew
from qaloom.functions import segments as sg
from qaloom.functions import tolerant_json as tj
from qaloom.functions import validation as vd
from qaloom.session import configure, shared_dir
from qaloom.sources import documents as docs
from qaloom.sources import failures as fl
from qaloom.sources import imports as im
from qaloom.streaming import ingest as ig
from qaloom.streaming import lease_tracker as lt
from qaloom.streaming import live
from qaloom.streaming.lease_fold import fold_leases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under the name of its function."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def _listed(column) -> F.Column:
    return F.array_join(column, "|")


# ---- text functions ---------------------------------------------------------

@query
def punctuation_set(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", F.array_join(tx.punctuation_set(F.col("text")), "").alias("marks")
    )


@query
def words(spark, d):
    found = tx.words(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", found.alias("w")).select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"),
        F.sha2(F.array_join("w", " "), 256).alias("words_hash"),
    )


@query
def row_hash(spark, d):
    return V.questions(spark, d).select(
        "id", tx.row_hash(F.col("instruction"), F.col("input"), F.col("output")).alias("row_hash")
    )


@query
def text_flags(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id",
        tx.has_latin_letter(F.col("text")).cast("int").alias("latin"),
        tx.has_punctuation(F.col("text")).cast("int").alias("marks"),
        F.length(tx.trim_punctuation(F.col("text"))).cast("bigint").alias("trimmed_chars"),
        F.length(tx.strip(F.concat(F.lit(" \n"), "text", F.lit(" \t")))).cast("bigint").alias("stripped_chars"),
    )


# ---- rules ------------------------------------------------------------------

@query
def failure_rows(spark, d):
    return R.failure_rows(R.judge(V.records(spark, d), "arabizi"))


@query
def rule_duplicate(spark, d):
    marked = R.mark_duplicates(V.question_records(spark, d))
    return marked.where("is_repeat").select("position", "source_id")


def _single(name: str, rule: Callable, view: Callable) -> None:
    def build(spark, d):
        flagged = view(spark, d).select("position", "source_id", rule().alias("hit"))
        return skew.fixed(flagged, "hit").where("hit").select("position", "source_id")

    build.__name__ = name
    query(build)


_single("rule_english", lambda: R.english(F.col("output")), V.records)
_single("rule_punctuation", lambda: R.punctuation(F.col("input"), F.col("output")), V.records)
_single("rule_output_punctuation", lambda: R.output_punctuation(F.col("output")), V.question_records)
_single("rule_word_mismatch", lambda: R.word_mismatch(F.col("input"), F.col("output")), V.question_records)
_single("rule_not_an_option", lambda: R.not_an_option(F.col("output")), V.records)


@query
def rule_tool_calling(spark, d):
    return R.apply_rules(V.tool_records(spark, d), "tool_calling").select(
        "position", _listed("fired").alias("checks"), "reason"
    )


@query
def findings(spark, d):
    """All four data types in one pass, the type taken from a column."""
    kind = F.when(F.col("instruction") == "fr", "arabizi").when(
        F.col("instruction") == "de", "arabic_grammar"
    ).when(F.col("instruction") == "es", "tool_calling").otherwise("saudi_dialect")
    return R.findings(R.judge(V.question_records(spark, d), kind))


@query
def unchecked_rows(spark, d):
    return R.unchecked_rows(R.apply_rules(V.tool_records(spark, d), "tool_calling"))


@query
def rule_summary(spark, d):
    return R.summary(R.judge(V.tool_records(spark, d), "tool_calling"))


# ---- analytics --------------------------------------------------------------

def _text_time(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return df


def _tables(spark, d):
    return V.questions(spark, d), V.reviews(spark, d), V.leases(spark, d), V.at(V.AS_OF)


@query
def progress(spark, d):
    return A.progress(A.question_state(*_tables(spark, d)))


@query
def progress_ready(spark, d):
    return A.progress(A.question_state(*_tables(spark, d), batches=V.batches(spark, d)))


@query
def progress_by_batch(spark, d):
    return A.progress(A.question_state(*_tables(spark, d)), ["batch_id"])


@query
def pass_rate(spark, d):
    rows = V.reviews(spark, d).groupBy("reviewer").agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("decision") == "Pass").alias("passed")
    )
    return rows.withColumn("pass_rate", A.pass_rate(F.col("passed"), F.col("reviewed")))


@query
def by_reviewer(spark, d):
    return A.by_reviewer(A.reviews_in(V.reviews(spark, d), V.questions(spark, d), None))


@query
def over_time(spark, d):
    return A.over_time(A.reviews_in(V.reviews(spark, d), V.questions(spark, d), None))


@query
def share_of_max(spark, d):
    return A.share_of_max(A.by_reviewer(V.reviews(spark, d)))


@query
def batch_list(spark, d):
    questions, reviews, _, _ = _tables(spark, d)
    return _text_time(A.batch_list(V.batches(spark, d), questions, reviews), "uploaded_at")


@query
def held_back(spark, d):
    questions, reviews, _, _ = _tables(spark, d)
    return A.held_back(A.batch_list(V.batches(spark, d), questions, reviews))


@query
def review_search(spark, d):
    questions, reviews, _, _ = _tables(spark, d)
    found = S.search_reviews(reviews, questions, V.batches(spark, d), " THE%_r ", limit=50)
    return _text_time(S.with_decision(found, "Pass"), "reviewed_at")


@query
def review_search_by_id(spark, d):
    questions, reviews, _, _ = _tables(spark, d)
    return _text_time(S.search_reviews_by_id(reviews, questions, "R3"), "reviewed_at")


@query
def export_rows(spark, d):
    questions, reviews, _, _ = _tables(spark, d)
    return S.export_rows(reviews, questions)


# ---- leases and decisions ---------------------------------------------------

@query
def lease_status(spark, d):
    return L.status(V.leases(spark, d), V.at(V.AS_OF)).select("question_id", "reviewer", "status")


@query
def lease_expiry_audit(spark, d):
    return _text_time(L.sweep(V.leases(spark, d), V.at(V.AS_OF))["audit"], "created_at")


@query
def renew_batch(spark, d):
    outcomes = L.renew(V.requests(spark, d), V.leases(spark, d), V.at(V.AS_OF))["outcomes"]
    return outcomes.select("request_id", "question_id", "reviewer", F.col("renewed").cast("int").alias("renewed"))


@query
def renewed_leases(spark, d):
    rows = L.renew(V.requests(spark, d), V.leases(spark, d), V.at(V.AS_OF))["leases"]
    return _text_time(rows, "assigned_at", "last_activity_at", "lease_expires_at")


@query
def skip_batch(spark, d):
    outcomes = L.skip(V.requests(spark, d), V.leases(spark, d), V.at(V.AS_OF))["outcomes"]
    return outcomes.select("request_id", "question_id", "reviewer", "reason")


@query
def submit_batch(spark, d):
    _, reviews, leases, _ = _tables(spark, d)
    outcomes = D.submit(V.requests(spark, d), reviews, leases)["outcomes"]
    return outcomes.select("request_id", "question_id", "reviewer", "reason")


@query
def submitted_reviews(spark, d):
    _, reviews, leases, _ = _tables(spark, d)
    return _text_time(D.submit(V.requests(spark, d), reviews, leases)["reviews"], "reviewed_at")


def _claim(spark, d):
    questions, reviews, leases, as_of = _tables(spark, d)
    return L.claim(
        V.claims(spark, d), questions, reviews, leases, as_of, "seed", V.batches(spark, d)
    )


@query
def claim_batch(spark, d):
    return _claim(spark, d)["outcomes"]


@query
def claim_resume(spark, d):
    """Resuming alone: holders ask again for what they hold."""
    questions, reviews, leases, as_of = _tables(spark, d)
    claims = L.one_per_session(V.requests(spark, d).withColumnRenamed("request_id", "claim_id").select(
        "claim_id", "reviewer", "session_id", F.col("question_id").alias("exclude_question_id")
    ))
    held = L.resumable(reviews, leases, as_of).drop("assigned_at")
    return skew.join_unique(claims, held, ["reviewer", "session_id"], "inner").select(
        "reviewer", "session_id", "question_id"
    )


def _bulk_items(spark, d):
    """Repeats among the stored questions, and every failed conversation record."""
    # Digests are taken where the texts are read; only they meet in the join.
    hashed = V.question_records(spark, d).select(
        "source_id", "position", tx.question_key(F.col("instruction"), F.col("input")).alias("key"),
        tx.row_hash(F.col("instruction"), F.col("input"), F.col("output")).alias("row_hash"),
    )
    stored = skew.mark_repeats(hashed, ["key"], F.col("position")).where("is_repeat").select(
        "source_id", F.lit(R.NOTES["duplicate"]).alias("notes"), "row_hash", F.col("position").alias("ord"),
    )
    other = R.failure_rows(R.judge(V.records(spark, d), "arabizi")).select(
        "source_id", "notes", "row_hash", F.col("position").alias("ord")
    )
    return stored.unionByName(other)


def _bulk(spark, d):
    questions, reviews, _, as_of = _tables(spark, d)
    return D.bulk_fail(_bulk_items(spark, d), questions, reviews, F.lit("admin"), as_of)


@query
def bulk_fail_actions(spark, d):
    return _bulk(spark, d)["actions"].select("question_id", "source_id", "row_hash", "item_notes", "action")


@query
def bulk_fail_summary(spark, d):
    return D.bulk_fail_summary(_bulk(spark, d))


@query
def bulk_fail_unmatched(spark, d):
    return _bulk(spark, d)["unmatched"]


@query
def auto_vs_human(spark, d):
    """Decisions by kind once the bulk failure is applied."""
    changes, reviews = _bulk(spark, d), V.reviews(spark, d)
    replaced = changes["replaced_reviews"]
    columns = ["question_id", "decision", "reviewer"]
    kept = reviews.join(replaced.select("question_id"), "question_id", "left_anti")
    now = kept.select(*columns).unionByName(replaced.select(*columns)).unionByName(
        changes["reviews"].select(*columns)
    )
    return A.auto_vs_human(now)


@query
def reset_reviews(spark, d):
    asked = V.requests(spark, d).select(
        "request_id", F.col("question_id").alias("review_id"), F.col("reviewer").alias("actor")
    )
    return D.reset(asked, V.reviews(spark, d), V.at(V.AS_OF))["outcomes"].select(
        "request_id", "review_id", "reason"
    )


@query
def delete_batches(spark, d):
    questions, reviews, leases, as_of = _tables(spark, d)
    asked = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("batch_id"))
    return D.delete_batches(
        asked, V.batches(spark, d), questions, reviews, leases, F.lit("admin"), as_of
    )["outcomes"]


@query
def audit_by_type(spark, d):
    """The events of an expiry sweep, skips, resets and a bulk failure, counted by type."""
    questions, reviews, leases, as_of = _tables(spark, d)
    asked = V.requests(spark, d)
    resets = asked.select("request_id", F.col("question_id").alias("review_id"), F.lit("admin").alias("actor"))
    return audit.by_type(audit.log(
        L.sweep(leases, as_of)["audit"], L.skip(asked, leases, as_of)["audit"],
        D.reset(resets, reviews, as_of)["audit"], _bulk(spark, d)["audit"],
    ))


@query
def lease_sessions(spark, d):
    """Activity on a question, cut where 30 minutes pass without any."""
    runs = skew.sessions(V.lease_events(spark, d), "question_id", "at", L.LEASE)
    return _text_time(runs, "started_at", "last_at")


# ---- ingest -----------------------------------------------------------------

@query
def parse_documents(spark, d):
    """Upload documents read from their text: the number of records, or why there are none."""
    return docs.parse_documents(V.document_texts(spark, d)).select(
        "event_id", F.when(F.col("data").isNotNull(), F.size("data")).cast("bigint").alias("n_records"), "error")


def _upload_number() -> F.Column:
    return F.regexp_extract("file", r"up=(\d+)", 1).cast("bigint").alias("up")


@query
def json_lines(spark, d):
    """Records of JSON Lines files by line number, with their output where they can be read."""
    read = docs.read_json_lines(spark, V.json_lines_files(spark, d, _work(spark, "lines")))
    return read.select(
        _upload_number(), "row", F.col("record").isNotNull().alias("is_json"), F.try_variant_get("record", "$.output", "string").alias("output"))


@query
def json_lines_digests(spark, d):
    """One digest per JSON Lines file, from a hash tree over its lines."""
    lines = docs.read_lines(spark, V.json_lines_files(spark, d, _work(spark, "lines")))
    return docs.lines_files(lines).select(_upload_number(), "lines", "file_hash")


def _validator(profile: str) -> None:
    def build(spark, d):
        return docs.validated(V.raw_records(spark, d), profile).select("file", "row", "message")

    build.__name__ = f"validate_{profile}"
    query(build)


for _profile in vd.PROFILES:
    _validator(_profile)


@query
def input_normalised(spark, d):
    judged = docs.validated(V.raw_records(spark, d), "browser")
    valid = docs.fields(judged.where(F.col("message").isNull()))
    return valid.select(
        "row", "source_id", F.size("input").cast("bigint").alias("n_parts"),
        tx.input_text(F.col("input")).alias("input"), tx.stored_input(F.col("input")).alias("stored"),
    )


@query
def load_records(spark, d):
    return docs.load_records(V.raw_records(spark, d))[0].select("file", "position", "source_id")


@query
def malformed_rows(spark, d):
    return docs.load_records(V.raw_records(spark, d))[1]


@query
def upload_preview(spark, d):
    return docs.preview_counts(docs.validated(V.raw_records(spark, d)))


def _import(spark, d):
    return im.import_records(
        V.upload_files(spark, d), V.raw_records(spark, d), V.batches(spark, d), V.at(V.AS_OF)
    )


@query
def import_batches(spark, d):
    return _text_time(_import(spark, d)["batches"], "uploaded_at")


@query
def import_questions(spark, d):
    rows = _import(spark, d)["questions"].withColumn("input", tx.input_text(F.col("input")))
    return _text_time(rows, "imported_at")


@query
def file_dedupe(spark, d):
    """Every document as a file; the benchmark texts as files already stored."""
    files = V.table(spark, d, "documents").select(
        F.col("doc_id").alias("file"), F.sha2("text", 256).alias("file_hash")
    )
    stored = V.table(spark, d, "benchmark").select(F.sha2("text", 256).alias("file_hash"))
    return im.dedupe_files(files, stored).select("file", "reason")


@query
def finish_import(spark, d):
    asked = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("batch_id"))
    return im.finish_imports(asked, V.batches(spark, d))["outcomes"]


@query
def import_chunks(spark, d):
    """Every event as a chunk of its user's upload, as far as that is open."""
    chunks = V.table(spark, d, "events").select(
        F.col("user_id").alias("batch_id"), F.lit(1).cast("bigint").alias("imported"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("skipped"),
    )
    grown = im.add_chunks(chunks, V.batches(spark, d))["batches"]
    return grown.select("id", "imported_count", "skipped_count")


@query
def failure_reader(spark, d):
    rows = R.failure_rows(R.judge(V.records(spark, d), "arabizi"))
    padded = rows.withColumn("notes", F.concat(F.lit(" \n"), "notes", F.lit(" ")))
    return fl.read_failures(padded)


# ---- JSON in text -----------------------------------------------------------

@query
def relaxed_json(spark, d):
    records = V.tool_records(spark, d)
    return records.select(
        "position", tj.relax(F.col("instruction")).alias("instruction"), tj.relax(F.col("output")).alias("output")
    )


@query
def contains_json(spark, d):
    split = sg.segments(V.table(spark, d, "events"), "props")
    return split.select("event_id", sg.contains_json(F.col("segments")).cast("int").alias("has_json"))


@query
def json_segments(spark, d):
    """Prose, a fenced block, and bare JSON of every event's log line."""
    fence = "`" * 3
    line = F.concat(
        "event_type", F.lit(" {x} "), "props", F.lit(f" then {fence}json\n[1, "), "props",
        F.lit(f"]\n{fence} end [unclosed"),
    )
    rows = sg.json_segments(
        V.table(spark, d, "events").select("event_id", line.alias("line")), ["event_id"], "line"
    )
    return rows.select("event_id", F.col("ix").cast("bigint").alias("ix"), "text",
                       F.col("is_json").cast("int").alias("is_json"))


def _exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per element. An outer explode lets no filter repeat the work below it."""
    return df.select("position", F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


@query
def tool_catalog(spark, d):
    return _exploded(tl.with_tools(V.tool_records(spark, d)), "tools", "t").select(
        "position", "t.name", _listed(F.array_sort("t.properties")).alias("properties"),
        _listed("t.required").alias("required"),
    )


@query
def tool_calls(spark, d):
    return _exploded(tl.with_calls(V.tool_records(spark, d)), "calls", "c").select("position", "c.name", _listed(F.array_sort("c.arguments")).alias("arguments"))


@query
def tool_catalog_params(spark, d):
    found = tl.with_tool_definitions(V.tool_records(spark, d))
    return tl.catalog(found, ["position"]).select(
        "position", "name", "description", "param", "type", "param_description",
        F.col("required").cast("int").alias("required"),
    )


@query
def schema_lint(spark, d):
    tools = tl.with_tools(V.tool_records(spark, d))
    lint = tools.withColumn("lint", tl.undeclared_required(F.col("tools")))
    return _exploded(lint, "lint", "t").select("position", "t.name", _listed("t.undeclared").alias("undeclared"))


# ---- streams ----------------------------------------------------------------

def _work(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, for what a stream writes."""
    return f"{shared_dir(spark)}/qaloom/{name}-{uuid.uuid4().hex}"


def _outcomes(df: DataFrame) -> DataFrame:
    shown = df.select(
        "question_id", "at", "event_id", "action", "outcome", "reviewer", "decision", "notes",
        "reason", "lease_expires_at",
    )
    return _text_time(shown, "at", "lease_expires_at")


@query
def lease_fold(spark, d):
    return _outcomes(fold_leases(V.lease_events(spark, d)))


@query
def lease_stream(spark, d):
    folder = _work(spark, "leases")
    actions = V.as_lease_events(V.stream(spark, d, "events"))
    lt.run_tracker(actions, f"{folder}/out", f"{folder}/state", finish=True).awaitTermination()
    return _outcomes(lt.read_outcomes(spark, f"{folder}/out"))


@query
def live_by_reviewer(spark, d):
    folder = _work(spark, "reviewers")
    counts = live.reviewer_counts(V.as_reviews(V.stream(spark, d, "labels")))
    live.keep_latest(counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return live.latest(spark, f"{folder}/out", "reviewer")


@query
def live_over_time(spark, d):
    folder = _work(spark, "days")
    counts = live.daily_counts(V.as_reviews(V.stream(spark, d, "labels")))
    live.keep_latest(counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return live.latest(spark, f"{folder}/out", "date")


@query
def incremental_ingest(spark, d):
    """Chunks of uploads, of which some are open, some ready, some unknown."""
    folder = _work(spark, "ingest")
    raw = V.as_raw_texts(V.stream(spark, d, "events")).select(
        F.expr("cast(substr(file, 2) as bigint)").alias("batch_id"), "row", "line"
    )
    ig.ingest_chunks(raw, lambda s: V.upload_status(s, d), f"{folder}/out", f"{folder}/state").awaitTermination()
    return ig.counts(spark, f"{folder}/out")


@query
def incremental_duplicates(spark, d):
    folder = _work(spark, "repeats")
    arriving = V.as_records(V.as_questions(V.stream(spark, d, "documents")))
    ig.mark_arriving(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    return ig.marked(spark, f"{folder}/out").where("is_repeat").select("position", "source_id")
