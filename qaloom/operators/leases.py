"""Leases: status, expiry, claims, renewal, skipping.

A lease is live while its end lies after the moment asked about; at the very end
it has expired. Every operator works on sets and returns change sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.operators import audit
from qaloom.operators.skew import hash_rank, join_unique, mark_repeats
from qaloom.session import cut

# Lease length and refusal messages.
LEASE = "30 minutes"
INACTIVE = "This assignment is no longer active."
WHO_REQUIRED = "Reviewer and session ID are required."

Changes = dict[str, DataFrame]
OWNER = ["question_id", "reviewer", "session_id"]


def is_live(as_of: Column) -> Column:
    return F.col("lease_expires_at") > as_of


def lease_end(moment: Column, length: str = LEASE) -> Column:
    return moment + F.expr(f"interval {length}")


def status(leases: DataFrame, as_of: Column) -> DataFrame:
    return leases.withColumn("status", F.when(is_live(as_of), "live").otherwise("expired"))


def sweep(leases: DataFrame, as_of: Column) -> Changes:
    """Split off expired leases; each leaves one audit row in its holder's name."""
    gone = leases.where(~is_live(as_of))
    return {
        "live": leases.where(is_live(as_of)),
        "dropped": gone.select("question_id"),
        "audit": audit.rows(gone, "lease_expired", as_of, actor=F.col("reviewer")),
    }


def _new_lease(rows: DataFrame, as_of: Column, assigned_at: Column) -> DataFrame:
    return rows.select(
        *OWNER, assigned_at.alias("assigned_at"), as_of.alias("last_activity_at"),
        lease_end(as_of).alias("lease_expires_at"),
    )


def renew(requests: DataFrame, leases: DataFrame, as_of: Column) -> Changes:
    """Extend live leases of their own holders; ``outcomes`` tells each request."""
    asked = requests.withColumn("reviewer", tx.strip(F.col("reviewer")))
    live = leases.where(is_live(as_of)).select(*OWNER, F.lit(True).alias("_live"))
    outcomes = join_unique(asked, live, OWNER).withColumn(
        "renewed", F.coalesce(F.col("_live"), F.lit(False))
    ).drop("_live")
    held = leases.where(is_live(as_of)).join(asked.select(*OWNER).distinct(), OWNER, "left_semi")
    return {"outcomes": outcomes, "leases": _new_lease(held, as_of, F.col("assigned_at"))}


def skip(requests: DataFrame, leases: DataFrame, as_of: Column, with_audit: bool = True) -> Changes:
    """Give up one's own lease, run out or not. The first request of a lease wins."""
    asked = requests.withColumn("reviewer", tx.strip(F.col("reviewer")))
    held = leases.select(*OWNER, F.lit(True).alias("_held"))
    marked = mark_repeats(join_unique(asked, held, OWNER), OWNER, F.col("request_id"), "_again")
    outcomes = marked.withColumn(
        "reason", F.when(F.col("_held").isNull() | F.col("_again"), INACTIVE)
    ).drop("_held", "_again")
    done = outcomes.where(F.col("reason").isNull())
    changes = {"outcomes": outcomes, "dropped": done.select("question_id")}
    if with_audit:
        changes["audit"] = audit.rows(done, "skip", as_of, actor=F.col("reviewer"))
    return changes


def claim_pool(
    questions: DataFrame, reviews: DataFrame, leases: DataFrame, as_of: Column,
    batches: DataFrame | None = None,
) -> DataFrame:
    """Ids that may be claimed: not reviewed, no live lease, upload ready if asked."""
    pool = questions.select("id", "batch_id")
    if batches is not None:
        ready = batches.where("status = 'ready'").select(F.col("id").alias("batch_id"))
        pool = pool.join(ready, "batch_id", "left_semi")
    taken = reviews.select(F.col("question_id").alias("id"))
    held = leases.where(is_live(as_of)).select(F.col("question_id").alias("id"))
    return pool.select("id").join(taken, "id", "left_anti").join(held, "id", "left_anti")


def one_per_session(claims: DataFrame) -> DataFrame:
    """The earliest claim of each reviewer and session, which alone can get a new question."""
    cleaned = claims.withColumn("reviewer", tx.strip(F.col("reviewer")))
    return cleaned.groupBy("reviewer", "session_id").agg(
        F.min("claim_id").alias("claim_id"),
        F.min_by("exclude_question_id", "claim_id").alias("exclude_question_id"),
    )


def resumable(reviews: DataFrame, leases: DataFrame, as_of: Column) -> DataFrame:
    """The question each reviewer and session already holds and has not reviewed."""
    taken = reviews.select("question_id")
    held = leases.where(is_live(as_of)).join(taken, "question_id", "left_anti")
    return held.groupBy("reviewer", "session_id").agg(
        F.min("question_id").alias("question_id"),
        F.min_by("assigned_at", "question_id").alias("assigned_at"),
    )


def _digest(seed: str, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def assign(claims: DataFrame, pool: DataFrame, seed: str) -> DataFrame:
    """Give every claim its own random question of the pool, as far as it reaches.

    Both sides are put in a seeded random order and joined on their rank. A claim
    that meets the question it excludes passes it on: such claims swap questions in
    a ring; a single one takes the first question nobody got, and leaves its own to
    the first claim without a question that may have it. As the order is random, the
    number of such claims is about one, whatever the number of claims.
    """
    session = _digest(seed, "reviewer", "session_id")
    asking = hash_rank(claims.withColumn("_digest", session), "_digest", "rank").drop("_digest")
    offered = hash_rank(
        pool.withColumn("_digest", _digest(seed, "id")), "_digest", "rank",
        first=asking.select(F.max("rank") + 1).scalar(),
    ).select("rank", F.col("id").alias("question_id"))
    # One row per claim, and one more for the first question nobody got. What
    # follows reads these few rows more than once, so they are kept.
    paired = cut(asking.join(offered, "rank", "full"))
    clashes = paired.where(_clash()).count()
    if clashes == 1:
        paired = _pass_on(paired)
    elif clashes > 1:
        paired = _swap_in_ring(paired, session)
    return paired.where(F.col("claim_id").isNotNull()).drop("rank")


def _clash() -> Column:
    same = F.col("question_id") == F.col("exclude_question_id")
    return F.col("claim_id").isNotNull() & F.coalesce(same, F.lit(False))


def _pass_on(paired: DataFrame) -> DataFrame:
    """The one clashing claim takes the spare question; without one, it leaves its own."""
    asked, clash = F.col("claim_id").isNotNull(), _clash()
    spare = paired.where(~asked).select(F.min("question_id")).scalar()
    left_over = paired.where(clash).select(F.min("question_id")).scalar()
    may_have = ~F.coalesce(F.col("exclude_question_id") == left_over, F.lit(False))
    heir = paired.where(asked & F.col("question_id").isNull() & spare.isNull() & may_have)
    given = F.when(clash, spare).when(
        F.col("rank") == heir.select(F.min("rank")).scalar(), left_over
    ).otherwise(F.col("question_id"))
    return paired.withColumn("question_id", given)


def _swap_in_ring(paired: DataFrame, session: Column) -> DataFrame:
    """Each clashing claim takes the question of the next one; none may meet its own."""
    ring = cut(hash_rank(
        paired.where(_clash()).withColumn("_digest", session), "_digest", "ring"
    ).select("rank", "ring", "question_id"))
    members = ring.select(F.count(F.lit(1))).scalar()
    moved = ring.select("rank", (F.col("ring") % members + 1).alias("ring")).join(
        ring.select("ring", F.col("question_id").alias("swapped")), "ring"
    ).select("rank", "swapped")
    swapped = F.coalesce("swapped", "question_id")
    return paired.join(moved, "rank", "left").withColumn("question_id", swapped).drop("swapped")


def claim(
    claims: DataFrame, questions: DataFrame, reviews: DataFrame, leases: DataFrame,
    as_of: Column, seed: str, batches: DataFrame | None = None,
) -> Changes:
    """Answer a batch of claims: resume one's own lease, else a new random question.

    ``outcomes`` holds one row per claim: a later claim of a reviewer and session resumes what
    the earliest got. ``leases`` holds the rows to add in place of older ones of the same
    question; ``audit`` the expiries found.
    """
    swept = sweep(leases, as_of)
    cleaned = claims.select("claim_id", tx.strip(F.col("reviewer")).alias("reviewer"), "session_id", "exclude_question_id")
    blank = F.coalesce(F.col("reviewer"), F.lit("")).eqNullSafe("") | (F.coalesce("session_id", F.lit("")) == "")
    who = ["reviewer", "session_id"]
    first = one_per_session(cleaned.where(~blank))
    valid = join_unique(first, resumable(reviews, leases, as_of), who)
    resumed = valid.where(F.col("question_id").isNotNull()).withColumn("outcome", F.lit("resumed"))
    fresh = valid.where(F.col("question_id").isNull()).drop("question_id", "assigned_at")
    pool = claim_pool(questions, reviews, leases, as_of, batches)
    given = assign(fresh, pool, seed).select(
        *who, "claim_id", "exclude_question_id", "question_id", as_of.alias("assigned_at"),
        F.when(F.col("question_id").isNull(), "none").otherwise("claimed").alias("outcome"),
    )
    refused = cleaned.where(blank).select(
        *who, "claim_id", "exclude_question_id", F.lit(None).cast("bigint").alias("question_id"),
        F.lit("refused").alias("outcome"),
    )
    answered = resumed.unionByName(given)
    held = answered.where(F.col("outcome").isin("resumed", "claimed"))
    answer = answered.select(*who, F.col("claim_id").alias("_first"), "question_id", "outcome")
    each = join_unique(cleaned.where(~blank), answer, who, "inner").withColumn(
        "outcome", F.when((F.col("claim_id") != F.col("_first")) & (F.col("outcome") == "claimed"), "resumed").otherwise(F.col("outcome"))
    ).drop("_first")
    return {
        "outcomes": each.unionByName(refused),
        "leases": _new_lease(held, as_of, F.col("assigned_at")),
        "dropped": swept["dropped"],
        "audit": swept["audit"],
    }
