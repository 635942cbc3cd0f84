"""The lease rules on a stream of actions, with one state and one timer per question."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql import types as T

from qaloom.functions.text import strip
from qaloom.streaming.lease_rules import OUTCOMES, Lease, advance, expired, timed, with_micros

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("at", T.TimestampType()),
    T.StructField("question_id", T.LongType()), T.StructField("reviewer", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("decision", T.StringType()), T.StructField("notes", T.StringType()),
])
# The lease, the moment of the next timer, the few actions that wait, and the number of parts that others were put in.
_STATE = T.StructType([
    T.StructField("reviewer", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("expires", T.LongType()), T.StructField("reviewed", T.BooleanType()),
    T.StructField("wakes", T.LongType()), T.StructField("waiting", T.StringType()), T.StructField("parts", T.LongType()),
])

#: Actions that wait beside the lease of their question, and milliseconds of the slots that more of them are put in.
FEW, SLOT = 4096, 60 * 60 * 1000

_OUTCOME = Row(*OUTCOMES.fieldNames())
_EVENT = namedtuple("_EVENT", ["at_us", "event_id", *ACTIONS.fieldNames()[3:]])

# Why a late action is refused; the action, and its question, that only moves the time.
LATE = "The action arrived after its time was closed."
MARK, NO_QUESTION = "mark", -(1 << 63)


def _millis(micros: int) -> int:
    """The first whole millisecond that is not before a moment."""
    return -(-micros // 1000)


def _place(event) -> tuple:
    """Order of the actions of a question, those without an id first."""
    return event.at_us, event.event_id is not None, event.event_id or 0


class LeaseTracker(StatefulProcessor):
    """One lease per question, and the actions on it whose time has not come.

    The state of a question is read and written once for all its actions of a micro-batch, and once when its timer fires: the timer
    stands at the next moment that matters, the first waiting action or the end of the lease, and once the watermark has passed it, all that
    is due by then is judged in order of time, however it arrived. Up to ``few`` actions wait beside the lease; more of them are put
    into slots of time, each written in parts that are never written again, and judged slot by slot. So no more than ``few`` actions of
    a question, or those of one slot, are in memory at a time.
    """

    def __init__(self, few: int = FEW, slot: int = SLOT) -> None:
        self.few, self.slot = few, slot

    def init(self, handle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", _STATE)
        self.pending = handle.getMapState("pending", "slot bigint, part bigint", "actions string")

    def _load(self) -> tuple[Lease, int | None, list, int]:
        """(the lease, the moment of the timer, the few waiting actions, the number of parts)."""
        held = self.lease.get()
        return (Lease(*held[:4]), held[4], json.loads(held[5]), held[6]) if held else (Lease(), None, [], 0)

    def _store(self, lease: Lease, wakes: int | None, waiting: list, parts: int) -> None:
        if lease == Lease() and wakes is None:
            self.lease.clear()
        else:
            self.lease.update((*lease, wakes, json.dumps(waiting), parts))

    def _spread(self, waiting: list, parts: int) -> int:
        """Put waiting actions into their slots; returns the number of parts."""
        slots = {}
        for action in waiting:
            slots.setdefault(action[0] // 1000 // self.slot, []).append(action)
        for slot, actions in slots.items():
            self.pending.updateValue((slot, parts), (json.dumps(actions),))
        return parts + 1

    def _take(self, places: list, now: int):
        """The actions of each slot that has begun, in order of time; they are no longer in it then."""
        for slot, parts in groupby(places, itemgetter(0)):
            if slot * self.slot > now:
                return
            actions = []
            for place in map(tuple, parts):
                actions += json.loads(self.pending.getValue(place)[0])
                self.pending.removeKey(place)
            yield actions

    def handleInputRows(self, key, rows, timerValues):
        lease, wakes, waiting, parts = self._load()
        first = None
        for row in rows:
            if row.action == MARK:
                continue
            waiting.append([row[c] for c in _EVENT._fields])
            first = row.at_us if first is None else min(first, row.at_us)
            if len(waiting) > self.few:
                waiting, parts = [], self._spread(waiting, parts)
        if first is not None:
            if wakes is None or first // 1000 < wakes:
                wakes = first // 1000
                self.handle.registerTimer(wakes)
            self._store(lease, wakes, waiting, parts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        lease, wakes, waiting, parts = self._load()
        if wakes is None or wakes > now:
            # A timer of before an earlier action came; what was due then has been judged.
            return
        places = []
        if parts:
            parts = self._spread(waiting, parts)
            places = sorted(map(tuple, self.pending.keys()))
        later = []
        for actions in self._take(places, now) if parts else [waiting]:
            for event in sorted(map(_EVENT._make, actions), key=_place):
                if event.at_us // 1000 > now:
                    later.append(event)
                    continue
                lease, out = advance(key[0], lease, event)
                for values in out:
                    yield _OUTCOME(*values)
        if lease.expires is not None and _millis(lease.expires) <= now:
            yield _OUTCOME(*expired(key[0], lease))
            lease = Lease(reviewed=lease.reviewed)
        following = [slot * self.slot for slot, _ in places if slot * self.slot > now][:1]
        following += [event.at_us // 1000 for event in later[:1]]
        following += [_millis(lease.expires)] if lease.expires is not None else []
        wakes = min(following, default=None)
        if wakes is not None:
            self.handle.registerTimer(wakes)
        parts = parts if places and places[-1][0] * self.slot > now else 0
        if len(later) > self.few:
            later, parts = [], self._spread(later, parts)
        self._store(lease, wakes, later, parts)

    def close(self) -> None:
        pass


def track_leases(actions: DataFrame, delay: str = "1 minute", few: int = FEW, slot: int = SLOT) -> DataFrame:
    """Outcome stream of an action stream.

    An action is judged when the watermark, ``delay`` behind the newest action, has passed it. Spark drops actions that come later than
    that: ``run_tracker`` tells them apart in front.
    """
    spark = actions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    outcomes = (
        with_micros(actions).withWatermark("at", delay).groupBy("question_id")
        .transformWithState(LeaseTracker(few, slot), OUTCOMES, "Append", "EventTime")
    )
    return timed(outcomes)


# Which outcomes belong to which table.
TABLES = {
    "leases": ["claimed", "resumed", "renewed"], "reviews": ["submitted"],
    "audit": ["expired", "skipped"], "refused": ["refused", "none", "late"],
}


def into_tables(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each kind of outcome goes to its own table.

    Every micro-batch owns one folder and replaces it, so a repeated one is no
    repeated row.
    """
    def write(outcomes: DataFrame, batch: int) -> None:
        table = F.coalesce(*[
            F.when(F.col("outcome").isin(kinds), F.lit(name)) for name, kinds in TABLES.items()
        ])
        (
            outcomes.withColumn("table", table).write.mode("overwrite")
            .partitionBy("table").parquet(f"{path}/batch={batch}")
        )

    return write


def read_outcomes(spark, path: str) -> DataFrame:
    """The outcome tables under ``path``, with the name of each row's ``table``; without rows too."""
    fields = [f"{f.name} {'timestamp' if f.name in ('at', 'lease_expires_at') else f.dataType.simpleString()}" for f in OUTCOMES.fields]
    return spark.read.schema(", ".join([*fields, "table string", "batch string"])).parquet(path)


_TIMES = "newest bigint, closed bigint"


def _interval_ms(delay: str):
    return F.expr(f"unix_micros(timestamp_micros(0) + interval {delay}) div 1000")


def _times(spark, *folders: str) -> tuple[int | None, int | None]:
    return tuple(spark.read.schema(_TIMES).parquet(*folders).agg(F.max("newest"), F.max("closed")).first())


def admit(actions: DataFrame, path: str, state: str, delay: str = "1 minute"):
    """Split arriving actions into those whose time is open and late ones.

    Time is closed up to ``delay`` before the newest action of the earlier micro-batches, the same moment that the watermark of what
    reads the admitted actions can have reached at most. Late actions, and those without a time, go to the table of refused ones.
    Each micro-batch replaces its own folders.
    """
    def write(arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        before = [f"{state}/times/finish", *([f"{state}/times/batch-{batch - 1}"] if batch else [])]
        newest, closed = _times(spark, *before)
        ms = F.floor(F.unix_micros("at") / 1000)
        open_ = ms.isNotNull() & (F.lit(True) if closed is None else ms > closed)
        folder = f"{state}/arrived/batch-{batch}"
        shown = arrived.select(*ACTIONS.fieldNames(), (~open_).alias("late"))
        shown.write.mode("overwrite").partitionBy("late").parquet(folder)
        held = spark.read.schema(f"{ACTIONS.simpleString()[7:-1].replace(':', ' ')}, late boolean").parquet(folder)
        notes = F.when(F.col("decision") == "Fail", strip(F.coalesce("notes", F.lit("")))).otherwise("")
        held.where("late").select(
            "question_id", "at", "event_id", "action", F.lit("late").alias("outcome"), strip(F.coalesce("reviewer", F.lit(""))).alias("reviewer"),
            "session_id", "decision", notes.alias("notes"), F.lit(LATE).alias("reason"), F.lit(None).cast("timestamp").alias("lease_expires_at"),
            F.lit("refused").alias("table"),
        ).write.mode("overwrite").partitionBy("table").parquet(f"{path}/batch=late-{batch}")
        top = F.greatest(F.max(F.floor(F.unix_micros("at") / 1000)), F.lit(newest).cast("bigint"))
        held.where("not late").agg(top.alias("newest")).select(
            "newest", F.greatest(F.col("newest") - _interval_ms(delay), F.lit(closed).cast("bigint")).alias("closed")
        ).write.mode("overwrite").parquet(f"{state}/times/batch-{batch}")

    spark = actions.sparkSession
    spark.createDataFrame([(None, None)], _TIMES).write.mode("ignore").parquet(f"{state}/times/finish")
    return (
        actions.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/front")
        .trigger(availableNow=True).start()
    )


def _close_time(spark, state: str, delay: str) -> None:
    """Let all time up to the newest action be closed: nothing waits any longer, and what comes before it from now on is late."""
    newest, _ = _times(spark, f"{state}/times/*")
    if newest is None:
        return
    spark.createDataFrame([(newest, newest)], _TIMES).write.mode("overwrite").parquet(f"{state}/times/finish")
    at = F.timestamp_micros((F.lit(newest) + _interval_ms(delay)) * 1000)
    mark = spark.range(1).select(
        F.lit(None).cast("bigint").alias("event_id"), at.alias("at"), F.lit(NO_QUESTION).alias("question_id"),
        *[F.lit(MARK if c == "action" else None).cast("string").alias(c) for c in ACTIONS.fieldNames()[3:]])
    mark.write.mode("overwrite").parquet(f"{state}/arrived/finish-{newest}/late=false")


def run_tracker(
    actions: DataFrame, path: str, checkpoint: str, delay: str = "1 minute", finish: bool = False, few: int = FEW, slot: int = SLOT
):
    """Track what has arrived and stop; call again for what arrives later.

    Every action ends up in one table under ``path``, in whatever order and batches it came: judged in order of time if it came no later than
    ``delay`` after newer ones, else as a late one among the refused. Actions of the last ``delay`` wait for the next
    call, unless ``finish`` says that there is none.
    """
    spark = actions.sparkSession
    admit(actions, path, checkpoint, delay).awaitTermination()
    if finish:
        _close_time(spark, checkpoint, delay)
    admitted = spark.readStream.schema(ACTIONS).parquet(f"{checkpoint}/arrived/*/late=false")
    return (
        track_leases(admitted, delay, few, slot).writeStream.outputMode("append")
        .foreachBatch(into_tables(path)).option("checkpointLocation", f"{checkpoint}/leases")
        .trigger(availableNow=True).start()
    )
