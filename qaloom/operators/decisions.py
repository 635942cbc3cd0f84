"""Review decisions: submitting, resetting, failing in bulk; deleting uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.operators import audit
from qaloom.operators.analytics import AUTOMATIC_REVIEWER, batch_counts
from qaloom.operators.leases import INACTIVE, OWNER, Changes
from qaloom.operators.skew import join_unique, mark_repeats
from qaloom.session import cut

# Refusal messages.
BAD_DECISION = "Decision must be 'Pass' or 'Fail'."
NOTES_REQUIRED = "Failure notes are required."
REVIEWED = "This question has already been reviewed."
NO_REVIEW = "This review no longer exists."
NO_UPLOAD = "This upload no longer exists."
HAS_REVIEWS = (
    " question(s) in this upload have already been reviewed. "
    "Reset those reviews first if you really intend to remove it."
)


def submit(
    requests: DataFrame, reviews: DataFrame, leases: DataFrame, lease_first: bool = False
) -> Changes:
    """Record decisions of lease holders; the first acceptable one of a question wins.

    Every request is judged at its own ``requested_at``. ``lease_first`` is the
    hosted order of the two conflict checks.
    """
    asked = requests.withColumn("reviewer", tx.strip(F.col("reviewer"))).withColumn(
        "notes", tx.strip(F.coalesce("notes", F.lit("")))
    )
    done = reviews.select("question_id", F.lit(True).alias("_reviewed"))
    held = leases.select(*OWNER, "lease_expires_at")
    seen = join_unique(join_unique(asked, done, ["question_id"]), held, OWNER)

    invalid = F.when(~F.col("decision").isin("Pass", "Fail"), BAD_DECISION).when(
        (F.col("decision") == "Fail") & (F.col("notes") == ""), NOTES_REQUIRED
    )
    reviewed = F.when(F.col("_reviewed"), REVIEWED)
    no_lease = F.when(
        ~F.coalesce(F.col("lease_expires_at") > F.col("requested_at"), F.lit(False)), INACTIVE
    )
    conflicts = (no_lease, reviewed) if lease_first else (reviewed, no_lease)
    judged = seen.withColumn("_reason", F.coalesce(invalid, *conflicts))

    # Later acceptable requests of a question lose; so do later ones refused for
    # want of a lease, which now meet the recorded review first.
    order = F.struct("requested_at", "request_id")
    winner = judged.where(F.col("_reason").isNull()).groupBy("question_id").agg(
        F.min(order).alias("_won")
    )
    late = order > F.col("_won")
    after = INACTIVE if lease_first else REVIEWED
    outcomes = join_unique(judged, winner, ["question_id"]).withColumn(
        "reason",
        F.when(late & (F.col("_reason").isNull() | (F.col("_reason") == INACTIVE)), after)
        .otherwise(F.col("_reason")),
    ).select(*asked.columns, "reason")
    taken = outcomes.where(F.col("reason").isNull())
    return {
        "outcomes": outcomes,
        "reviews": taken.select(
            "question_id", "decision",
            F.when(F.col("decision") == "Pass", "").otherwise(F.col("notes")).alias("notes"),
            "reviewer", F.col("requested_at").alias("reviewed_at"),
        ),
        "dropped_leases": taken.select("question_id"),
    }


def reset(requests: DataFrame, reviews: DataFrame, as_of: Column) -> Changes:
    """Take reviews back; each whole old row is kept in the audit log."""
    asked = mark_repeats(requests, ["review_id"], F.col("request_id"), "_again")
    known = reviews.select(F.col("id").alias("review_id"), F.lit(True).alias("_known"))
    outcomes = join_unique(asked, known, ["review_id"]).withColumn(
        "reason", F.when(F.col("_known").isNull() | F.col("_again"), NO_REVIEW)
    ).drop("_known", "_again")
    done = outcomes.where(F.col("reason").isNull()).select("review_id", "actor")
    gone = done.join(reviews.withColumn("review_id", F.col("id")), "review_id")
    details = F.struct("id", "question_id", "decision", "notes", "reviewer", "reviewed_at")
    return {
        "outcomes": outcomes,
        "dropped": gone.select("review_id", "question_id"),
        "audit": audit.rows(
            gone, "review_reset", as_of, F.col("actor"), review_id="review_id", details=details
        ),
    }


def latest_items(items: DataFrame, order: str) -> DataFrame:
    """One row per (source_id, row_hash); of repeated keys the last notes count."""
    return items.groupBy("source_id", "row_hash").agg(F.max_by("notes", order).alias("item_notes"))


def bulk_fail(
    items: DataFrame, questions: DataFrame, reviews: DataFrame, actor: Column, as_of: Column,
    order: str = "ord",
) -> Changes:
    """Fail every question whose source id and content match an item.

    Only ids and hashes travel: the text is digested where it is read. A failed
    question stays as it is, a passed one is rewritten with its old review kept in
    the audit log, an unreviewed one gets its review. Running it again changes nothing.
    The items and the matched questions are written once; every change set reads those.
    """
    wanted = cut(latest_items(items, order))
    keyed = questions.select(
        F.col("id").alias("question_id"), "source_id",
        tx.row_hash(F.col("instruction"), F.col("input"), F.col("output")).alias("row_hash"),
    )
    matched = join_unique(keyed, wanted, ["source_id", "row_hash"], "inner")
    old = reviews.select(
        "question_id", F.col("id").alias("review_id"), "decision", "notes", "reviewer", "reviewed_at"
    )
    actions = cut(matched.join(old, "question_id", "left").withColumn(
        "action",
        F.when(F.col("decision") == "Fail", "already_failed")
        .when(F.col("decision") == "Pass", "overwritten").otherwise("failed"),
    ))
    failed = actions.where("action = 'failed'")
    overwritten = actions.where("action = 'overwritten'")
    found = actions.select("source_id", "row_hash").distinct()

    def verdict(rows: DataFrame, *ids: str) -> DataFrame:
        return rows.select(
            *ids, "question_id", F.lit("Fail").alias("decision"), F.col("item_notes").alias("notes"),
            F.lit(AUTOMATIC_REVIEWER).alias("reviewer"), as_of.alias("reviewed_at"),
        )

    previous = F.struct(
        "review_id", "decision", "notes", "reviewer", "reviewed_at",
        F.col("item_notes").alias("replaced_with"),
    )
    return {
        "actions": actions,
        "reviews": verdict(failed),
        "replaced_reviews": verdict(overwritten, "review_id"),
        "dropped_leases": actions.where("action <> 'already_failed'").select("question_id"),
        "audit": audit.log(
            audit.rows(
                overwritten, "review_overridden", as_of, actor, review_id="review_id", details=previous
            ),
            audit.rows(
                failed, "auto_fail", as_of, actor, details=F.struct(F.col("item_notes").alias("notes"))
            ),
        ),
        "unmatched": wanted.join(found, ["source_id", "row_hash"], "left_anti")
        .select("source_id", "row_hash"),
    }


def bulk_fail_summary(changes: Changes) -> DataFrame:
    """Totals of a bulk failure in one row."""
    def n(name: str) -> Column:
        return F.count_if(F.col("action") == name).alias(name)

    unmatched = changes["unmatched"].select(F.count(F.lit(1))).scalar()
    return changes["actions"].select(
        n("failed"), n("overwritten"), n("already_failed")
    ).withColumn("unmatched", unmatched)


def delete_batches(
    requests: DataFrame, batches: DataFrame, questions: DataFrame, reviews: DataFrame,
    leases: DataFrame, actor: Column, as_of: Column,
) -> Changes:
    """Remove uploads that hold no reviewed question, with their questions and leases."""
    asked = requests.select("batch_id").distinct()
    known = batches.select(F.col("id").alias("batch_id"), F.lit(True).alias("_known"))
    judged = (
        asked.join(known, "batch_id", "left")
        .join(batch_counts(questions, reviews), "batch_id", "left")
        .fillna(0, ["stored", "reviewed"])
        .withColumn(
            "reason",
            F.when(F.col("_known").isNull(), NO_UPLOAD).when(
                F.col("reviewed") > 0, F.concat(F.col("reviewed").cast("string"), F.lit(HAS_REVIEWS))
            ),
        )
    )
    allowed = judged.where(F.col("reason").isNull()).select("batch_id", "stored")
    gone = questions.select("id", "batch_id").join(allowed, "batch_id", "left_semi")
    gone = gone.select(F.col("id").alias("question_id"))
    rows = batches.join(allowed.withColumnRenamed("batch_id", "id"), "id")
    details = F.struct(*[F.col(c) for c in batches.columns], F.col("stored").alias("deleted_questions"))
    return {
        "outcomes": judged.select("batch_id", "stored", "reviewed", "reason"),
        "dropped_batches": allowed.select("batch_id"),
        "dropped_questions": gone,
        "dropped_leases": leases.select("question_id").join(gone, "question_id", "left_semi"),
        "audit": audit.rows(
            rows, "batch_deleted", as_of, actor, question_id=None, details=details
        ),
    }
