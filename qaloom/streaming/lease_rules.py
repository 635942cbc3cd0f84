"""What one action does to the lease of one question.

The stream and the batch job share this function; Spark brings it the actions of a
question in order of time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.operators.decisions import BAD_DECISION, NOTES_REQUIRED, REVIEWED
from qaloom.operators.leases import INACTIVE, WHO_REQUIRED

# Moments are microseconds since the epoch here, free of any time zone.
LENGTH = 30 * 60 * 1_000_000

OUTCOMES = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("at", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("lease_expires_at", T.LongType()),
])


def with_micros(actions: DataFrame) -> DataFrame:
    return actions.withColumn("at_us", F.unix_micros("at"))


def timed(outcomes: DataFrame) -> DataFrame:
    """Outcomes with their moments as timestamps."""
    return outcomes.withColumns(
        {c: F.timestamp_micros(c) for c in ("at", "lease_expires_at")}
    )


class Lease(NamedTuple):
    """State of a question: its holder, and whether it is reviewed."""

    reviewer: str | None = None
    session_id: str | None = None
    expires: int | None = None
    reviewed: bool = False


def expired(question_id: int, lease: Lease) -> tuple:
    """The outcome row of a lease that ran out."""
    return (question_id, lease.expires, None, "expire", "expired", lease.reviewer,
            lease.session_id, None, None, None, lease.expires)


def advance(question_id: int, lease: Lease, event) -> tuple[Lease, list[tuple]]:
    """(new state, outcome rows) of one action.

    ``event`` has at_us, event_id, reviewer, session_id, action, decision, notes.
    """
    out = []
    if lease.expires is not None and lease.expires <= event.at_us:
        out.append(expired(question_id, lease))
        lease = Lease(reviewed=lease.reviewed)
    reviewer = (event.reviewer or "").strip()
    notes = (event.notes or "").strip()
    mine = lease.expires is not None and (lease.reviewer, lease.session_id) == (reviewer, event.session_id)
    renewed = Lease(reviewer, event.session_id, event.at_us + LENGTH, lease.reviewed)
    outcome, reason, state = "refused", INACTIVE, lease
    if event.action == "claim":
        if not reviewer or not event.session_id:
            reason = WHO_REQUIRED
        elif mine:
            outcome, reason, state = "resumed", None, renewed
        elif lease.reviewed or lease.expires is not None:
            outcome, reason = "none", None
        else:
            outcome, reason, state = "claimed", None, renewed
    elif event.action == "renew":
        if mine:
            outcome, reason, state = "renewed", None, renewed
    elif event.action == "skip":
        if mine:
            outcome, reason, state = "skipped", None, Lease()
    elif event.decision not in ("Pass", "Fail"):
        reason = BAD_DECISION
    elif event.decision == "Fail" and not notes:
        reason = NOTES_REQUIRED
    elif lease.reviewed:
        reason = REVIEWED
    elif mine:
        outcome, reason, state = "submitted", None, Lease(reviewed=True)
    kept = notes if event.decision == "Fail" else ""
    out.append((question_id, event.at_us, event.event_id, event.action, outcome, reviewer,
                event.session_id, event.decision, kept, reason, state.expires))
    return state, out
