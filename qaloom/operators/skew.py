"""Joins, ranks and runs that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.session import cut


def fixed(df: DataFrame, *columns: str) -> DataFrame:
    """The same frame, with costly computed columns fixed where they are computed.

    A later filter on them would be pushed down together with their expressions,
    which would then run twice. No filter passes a generator, here one of one row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a side that may be skewed to a side that holds one row per key.

    The digest of the keys joins along with them. Without it an aggregated right
    side would be joined in place, and adaptive execution could not split a hot
    partition of the left side; with it both sides have an exchange of their own.
    A right side that turns out small at run time is still broadcast, by its
    measured size.
    """
    spread = F.xxhash64(*[F.col(k) for k in keys])
    joined = left.withColumn("_spread", spread).join(
        right.withColumn("_spread", spread), [*keys, "_spread"], how
    )
    return joined.drop("_spread")


def mark_repeats(
    df: DataFrame, keys: list[str], order: Column, flag: str = "is_repeat",
    among: DataFrame | None = None,
) -> DataFrame:
    """Add ``flag``: true for every row that is not the first of its key.

    A partial minimum runs before the shuffle, so a key with any number of rows
    reaches its reducer as one row per task. Keys that occur once never enter the
    join. ``order`` must be unique within a key. ``among`` is the same rows before
    costly columns were added to them, to find the first ones in.
    """
    ordered = df.withColumn("_order", order)
    firsts = (
        (df if among is None else among).withColumn("_order", order).groupBy(*keys)
        .agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    joined = join_unique(ordered, firsts, keys)
    return joined.withColumn(
        flag, F.coalesce(F.col("_order") > F.col("_first"), F.lit(False))
    ).drop("_order", "_first")


def hash_rank(
    df: DataFrame, digest: str, rank: str, digits: int = 3, first: Column | None = None
) -> DataFrame:
    """Global 1-based rank in the order of a hex digest column, without one big sort.

    The leading digits of the digest cut the order into ``16 ** digits`` even
    buckets. Only their counts pass through one task: at most that many rows, which
    is also the size of what is broadcast. Digests must be unique. With ``first``
    only buckets that reach into the first so many ranks are sorted.
    """
    cut = df.withColumn("_bucket", F.substring(digest, 1, digits))
    below = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .drop("_n")
    )
    if first is not None:
        offsets = offsets.where(F.col("_offset") < first)
    inside = W.partitionBy("_bucket").orderBy(digest)
    ranked = (
        cut.join(F.broadcast(offsets), "_bucket")
        .withColumn(rank, F.row_number().over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )
    return ranked if first is None else ranked.where(F.col(rank) <= first)


def range_rank(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Add ``rank``: the 0-based global place of each row in the order of ``keys`` (nulls first).

    Rows are cut into ranges of the order, sorted in each range, and numbered there; only the counts of the
    ranges pass through one task, and are what is broadcast. Rows with equal keys are numbered in any order.
    The numbered rows are written once.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", inside))
    below = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_range").withColumn(rank, F.col("_at") + F.col("_offset")).drop(
        "_range", "_at", "_offset")


def _cells(df: DataFrame, key: str, moment: str, gap: str) -> DataFrame:
    """(key, _cell, _from, _to, _n, session_no): what each key has in intervals of half the gap.

    Two rows in one cell are less than the gap apart, so a cell lies in one run as a whole and its rows need no order.
    """
    cells = df.select(key, moment).groupBy(key, _cell(moment, gap).alias("_cell")).agg(
        F.min(moment).alias("_from"), F.max(moment).alias("_to"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(key).orderBy("_cell")
    new = F.coalesce(F.col("_from") >= F.lag("_to").over(w) + F.expr(f"interval {gap}"), F.lit(True))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumn("_new", new.cast("int")).withColumn("session_no", F.sum("_new").over(upto)).drop("_new")


def _cell(moment: str, gap: str) -> Column:
    """The number of the half gap that a moment lies in."""
    return F.expr(f"unix_micros({moment}) div (unix_micros(timestamp_micros(0) + interval {gap}) div 2)")


def sessions(df: DataFrame, key: str, moment: str, gap: str) -> DataFrame:
    """Runs of rows of one key with less than ``gap`` between neighbours.

    A partial aggregate per (key, half gap) runs before the shuffle, so a hot key reaches its reducers as one row per
    task and half gap; only those cells are put in order. Rows without a moment form a run of their own, the first of their key.
    """
    return _cells(df, key, moment, gap).groupBy(key, "session_no").agg(
        F.min("_from").alias("started_at"),
        F.max("_to").alias("last_at"),
        F.sum("_n").alias("events"),
    )


def with_sessions(df: DataFrame, key: str, moment: str, gap: str) -> DataFrame:
    """Add ``session_no``, the number of a row's run within its key."""
    numbers = _cells(df, key, moment, gap).select(key, F.coalesce("_cell", F.lit(-(1 << 62))).alias("_cell"), "session_no")
    placed = df.withColumn("_cell", F.coalesce(_cell(moment, gap), F.lit(-(1 << 62))))
    return join_unique(placed, numbers, [key, "_cell"]).drop("_cell")
