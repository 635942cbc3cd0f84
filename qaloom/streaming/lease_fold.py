"""The lease rules over a finished action log, as a batch job.

The log, in order of (question, time), is cut into chunks of a fixed number of actions, so a question with very many
actions is walked by many tasks, with or without pauses. Where a cut falls into a question, the chunk is first read as a transition: what
it makes of each state the question can be in at its start. A holder at a cut has made its last claim or renewal at a known time,
the last one of its own before the cut, so there is one state for each reviewer who was active in the half hour before, and that of no holder.
Transitions compose and the composition is associative: they are folded in blocks, and blocks of blocks, until one task can walk those of a
question; then the states at all cuts are known and every chunk is walked once more for its outcomes.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from qaloom.functions.text import strip
from qaloom.operators.skew import join_unique, range_rank
from qaloom.session import cut
from qaloom.streaming.lease_rules import LENGTH, OUTCOMES, Lease, advance, expired, timed, with_micros

#: Actions of a chunk, and transitions that one task composes.
CHUNK, BLOCK = 4096, 256
#: Stands for an action without a question.
NO_QUESTION = -(1 << 63)

_EVENT = namedtuple("_EVENT", "question_id at_us event_id reviewer session_id action decision notes")
_STATE = "struct<reviewer:string,session_id:string,expires:bigint,reviewed:boolean>"
_PIECE = f"question_id bigint, k bigint, entries array<{_STATE}>, exits array<{_STATE}>"
_FREE, _DONE = Lease(), Lease(reviewed=True)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _events(table: pa.Table) -> Iterable:
    """The actions of a table in order of their place."""
    ordered = table.sort_by("place")
    return map(_EVENT._make, zip(*(ordered.column(c).to_pylist() for c in _EVENT._fields)))


def _lease(state: dict | None) -> Lease:
    return _FREE if state is None else Lease(**state)


def after(states: Iterable[Lease], events: Iterable) -> dict[Lease, Lease]:
    """What a stretch of actions of one question makes of each state before it."""
    now = {s: [s] for s in {_FREE, *states}}
    for event in events:
        who = (event.reviewer or "").strip(), event.session_id
        for state in list(now):
            # An action changes the state of no holder, an ended one, and that of its own actor.
            if not state.reviewed and (state.expires is None or state.expires <= event.at_us or (state.reviewer, state.session_id) == who):
                new = advance(event.question_id, state, event)[0]
                if new != state:
                    now.setdefault(new, []).extend(now.pop(state))
    return {before: state for state, all_before in now.items() for before in all_before}


def follow(state: Lease, step: dict[Lease, Lease]) -> Lease:
    """The state after a step. One that the step does not know of is a lease that had ended before it."""
    return state if state.reviewed else step.get(state, step[_FREE])


def _steps(table: pa.Table) -> list[tuple[int, dict[Lease, Lease]]]:
    """(k, transition) of pieces, in order."""
    ordered = table.sort_by("k")
    columns = (ordered.column(c).to_pylist() for c in ("k", "entries", "exits"))
    return [(k, dict(zip(map(_lease, a), map(_lease, b)))) for k, a, b in zip(*columns)]


def _states_before(pieces: DataFrame, block: int) -> DataFrame:
    """(question_id, k, state): the state before each piece. ``k`` counts the pieces of a question from 0."""
    schema = f"question_id bigint, k bigint, state {_STATE}"
    arrow, piece = _arrow(schema), _arrow(_PIECE)

    def walk(table: pa.Table, start: Lease) -> pa.Table:
        question, found = table.column("question_id")[0].as_py(), []
        for k, step in _steps(table):
            found.append({"question_id": question, "k": k, "state": start._asdict()})
            start = follow(start, step)
        return pa.Table.from_pylist(found, arrow)

    def compose(table: pa.Table) -> pa.Table:
        steps = _steps(table)
        whole = {}
        for first in steps[0][1]:
            state = first
            for _, step in steps:
                state = follow(state, step)
            whole[first] = state
        row = {"question_id": table.column("question_id")[0].as_py(), "k": steps[0][0] // block,
               "entries": [s._asdict() for s in whole], "exits": [s._asdict() for s in whole.values()]}
        return pa.Table.from_pylist([row], piece)

    longest = pieces.agg(F.max("k")).first()[0]
    if longest is None or longest < block:
        return pieces.groupBy("question_id").applyInArrow(lambda table: walk(table, _FREE), schema)
    blocked = pieces.withColumn("b", F.expr(f"k div {block}"))
    outer = _states_before(cut(blocked.groupBy("question_id", "b").applyInArrow(compose, _PIECE)), block)

    def inner(table: pa.Table, before: pa.Table) -> pa.Table:
        return walk(table, _lease(before.column("state")[0].as_py()))

    return blocked.groupBy("question_id", "b").cogroup(
        outer.withColumnRenamed("k", "b").groupBy("question_id", "b")).applyInArrow(inner, schema)


def _possible(rows: DataFrame) -> DataFrame:
    """(question_id, chunk, reviewer, session_id, expires): the leases that may stand when a chunk goes on with a question.

    ``rows`` are the actions of questions that lie in several chunks. A reviewer's claims and renewals count once a chunk, and as
    far as the chunk of the next one, or to the last chunk that begins within their half hour.
    """
    starts = rows.groupBy("question_id", "chunk").agg(F.min("at_us").alias("start"))
    cell = F.expr(f"start div {LENGTH}")
    reach = starts.groupBy("question_id", cell.alias("cell")).agg(F.max("chunk").alias("reach"))
    who = strip(F.coalesce("reviewer", F.lit("")))
    touched = rows.where(F.col("action").isin("claim", "renew")).select("question_id", "chunk", who.alias("reviewer"), "session_id", "at_us")
    touched = touched.where("reviewer <> '' and session_id <> ''").groupBy("question_id", "chunk", "reviewer", "session_id").agg(
        (F.max("at_us") + LENGTH).alias("expires"))
    own = W.partitionBy("question_id", "reviewer", "session_id").orderBy("chunk")
    touched = touched.withColumn("next", F.lead("chunk").over(own))
    for k, moment in enumerate((f"expires - {LENGTH}", "expires - 1")):
        near = reach.withColumnRenamed("reach", f"reach{k}")
        touched = join_unique(touched.withColumn("cell", F.expr(f"({moment}) div {LENGTH}")), near, ["question_id", "cell"]).drop("cell")
    last = F.least(F.col("next"), F.greatest("reach0", "reach1"))
    spread = touched.where(last > F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, last)))
    return join_unique(spread, starts, ["question_id", "chunk"], "inner").where("start < expires").select(
        "question_id", "chunk", "reviewer", "session_id", "expires")


def _states_at_cuts(placed: DataFrame, block: int) -> DataFrame:
    """(chunk, question_id, state, goes_on): questions in several chunks, with their state before each, and whether another one follows."""
    spans = placed.groupBy("question_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).where("first < last")
    spans = cut(spans)
    rows = join_unique(placed, spans, ["question_id"], "inner").withColumn("k", F.col("chunk") - F.col("first"))
    arrow = _arrow(_PIECE)

    def read(table: pa.Table, possible: pa.Table) -> pa.Table:
        held = [Lease(*x) for x in zip(*(possible.column(c).to_pylist() for c in ("reviewer", "session_id", "expires")))]
        made = after(held, _events(table))
        row = {"question_id": table.column("question_id")[0].as_py(), "k": table.column("k")[0].as_py(),
               "entries": [s._asdict() for s in made], "exits": [s._asdict() for s in made.values()]}
        return pa.Table.from_pylist([row], arrow)

    pieces = rows.groupBy("question_id", "chunk").cogroup(cut(_possible(rows)).groupBy("question_id", "chunk")).applyInArrow(read, _PIECE)
    states = _states_before(cut(pieces), block)
    return join_unique(states, spans, ["question_id"], "inner").select(
        (F.col("first") + F.col("k")).alias("chunk"), "question_id", "state", (F.col("first") + F.col("k") < F.col("last")).alias("goes_on"))


def fold_leases(actions: DataFrame, as_of: Column | None = None, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Outcome of every action, and the expiry of every lease that ran out.

    ``actions``: question_id, at, event_id, reviewer, session_id, action, decision, notes. Leases that no later action of
    their question touches are seen as of ``as_of``. Actions without a question are told like those of one.
    """
    shown = with_micros(actions).withColumn("question_id", F.coalesce("question_id", F.lit(NO_QUESTION))).select(*_EVENT._fields)
    placed = range_rank(shown, ["question_id", "at_us", "event_id"], "place").withColumn("chunk", F.expr(f"place div {chunk}"))
    schema = StructType([*OUTCOMES.fields]).add("_open", "boolean")
    arrow = to_arrow_schema(schema)

    def walk(table: pa.Table, cuts: pa.Table) -> pa.Table:
        before = {q: (_lease(s), more) for q, s, more in zip(*(cuts.column(c).to_pylist() for c in ("question_id", "state", "goes_on")))}
        found, question, lease = [], None, _FREE

        def leave() -> None:
            if lease.expires is not None and not before.get(question, (None, False))[1]:
                found.append((*expired(question, lease), True))

        for event in _events(table):
            if event.question_id != question:
                leave()
                question, lease = event.question_id, before.get(event.question_id, (_FREE,))[0]
            lease, out = advance(question, lease, event)
            found.extend((*row, False) for row in out)
        leave()
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    cuts = _states_at_cuts(placed, block)
    walked = timed(placed.groupBy("chunk").cogroup(cuts.groupBy("chunk")).applyInArrow(walk, schema))
    if as_of is not None:
        walked = walked.where(~F.col("_open") | (F.col("at") <= as_of))
    return walked.withColumn("question_id", F.when(F.col("question_id") != NO_QUESTION, F.col("question_id"))).drop("_open")
