"""Records that keep arriving: stored while their upload is open, and checked for repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from qaloom.functions import text as tx
from qaloom.operators.skew import join_unique, mark_repeats
from qaloom.session import cut
from qaloom.sources import documents as docs
from qaloom.sources.imports import NOT_OPEN
from qaloom.streaming.lease_tracker import STATE_PROVIDER

Uploads = Callable[[SparkSession], DataFrame]


def _folder(path: str, table: str, batch: int | str) -> str:
    return f"{path}/{table}/batch={batch}"


def ingest_chunks(raw: DataFrame, uploads: Uploads, path: str, checkpoint: str, profile: str = "store"):
    """Store valid records of a stream of (batch_id, row, record text), refused ones apart.

    ``uploads`` gives the current (id, status) of uploads and is asked anew in every micro-batch. Records of an upload that is not
    ``uploading``, or not known, are refused as a whole chunk, whatever they hold. What a micro-batch saw of the uploads is kept with it, and each
    one writes its own folders: a repeated micro-batch decides and counts as it did before.
    """
    def write(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        gate = f"{checkpoint}/gate/batch-{batch}"
        now = uploads(spark).where("status = 'uploading'").select(F.col("id").alias("batch_id")).distinct()
        now.write.mode("ignore").parquet(gate)
        open_ids = spark.read.schema(now.schema).parquet(gate).withColumn("_open", F.lit(True))
        raw_rows = lines.withColumn("record", F.try_parse_json("line")).drop("line")
        judged = join_unique(docs.validated(raw_rows, profile), open_ids, ["batch_id"])
        closed = F.col("_open").isNull()
        judged = judged.withColumn("refusal", F.when(closed, NOT_OPEN).otherwise(F.col("message"))).withColumn("closed", closed)
        typed = cut(docs.fields(judged.drop("message", "_open")))
        ok = F.col("refusal").isNull()
        typed.where(ok).drop("refusal", "closed").write.mode("overwrite").parquet(_folder(path, "questions", batch))
        typed.where(~ok).drop("closed").write.mode("overwrite").parquet(_folder(path, "refused", batch))
        typed.groupBy("batch_id").agg(
            F.count_if(ok).alias("imported"), F.count_if(~ok & ~F.col("closed")).alias("skipped"), F.count_if("closed").alias("closed")
        ).write.mode("overwrite").parquet(_folder(path, "chunks", batch))

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, imported, skipped, closed) over all that has arrived; ``closed`` are records that came to an upload that was not open."""
    chunks = spark.read.schema("batch_id bigint, imported bigint, skipped bigint, closed bigint").parquet(f"{path}/chunks")
    return chunks.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in ("imported", "skipped", "closed")])


_MARK = T.StructType([
    T.StructField("position", T.LongType()), T.StructField("source_id", T.StringType()), T.StructField("is_repeat", T.BooleanType()),
])
_MARKED = Row(*_MARK.fieldNames())


class FirstOfKey(StatefulProcessor):
    """Remembers that a key came; of the rows that bring it first, the earliest is no repeat. Rows are not collected."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        known, best = self.seen.exists(), None
        for row in rows:
            if not known and (best is None or (row.arrival, row.position) < (best.arrival, best.position)):
                row, best = best, row
            if row is not None:
                yield _MARKED(row.position, row.source_id, True)
        if best is not None:
            self.seen.update((True,))
            yield _MARKED(best.position, best.source_id, False)

    def close(self) -> None:
        pass


_ARRIVED = "key binary, position bigint, source_id string, arrival bigint"


def mark_arriving(records: DataFrame, path: str, checkpoint: str):
    """Mark records that repeat one of an earlier arrival, or of their own: (position, source_id, is_repeat) under ``path``/marked.

    Repeats inside a micro-batch are found by a partial minimum, so at most one row of a key goes on to the keyed state,
    however common it is. State is kept per key and only the keys that arrive are looked at, so an arrival costs as much
    after a year as on the first day. Texts are read for their digests and not moved.
    """
    spark = records.sparkSession
    arrived_at = f"{checkpoint}/arrived"

    def write(arrived: DataFrame, batch: int) -> None:
        keyed = cut(arrived.select(tx.question_key(F.col("instruction"), F.col("input")).alias("key"), "position", "source_id"))
        marked = mark_repeats(keyed, ["key"], F.col("position")).withColumn("arrival", F.lit(batch).cast("bigint"))
        folder = f"{arrived_at}/batch-{batch}"
        marked.write.mode("overwrite").partitionBy("is_repeat").parquet(folder)
        held = arrived.sparkSession.read.schema(f"{_ARRIVED}, is_repeat boolean").parquet(folder)
        held.where("is_repeat").select(*_MARK.fieldNames()).write.mode("overwrite").parquet(_folder(path, "marked", f"own-{batch}"))

    def keep(marked: DataFrame, batch: int) -> None:
        marked.write.mode("overwrite").parquet(_folder(path, "marked", batch))

    records.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/front").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    firsts = spark.readStream.schema(_ARRIVED).parquet(f"{arrived_at}/*/is_repeat=false")
    marked = firsts.groupBy("key").transformWithState(FirstOfKey(), _MARK, "Append", "None")
    return (
        marked.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/keys")
        .trigger(availableNow=True).start()
    )


def marked(spark: SparkSession, path: str) -> DataFrame:
    """(position, source_id, is_repeat) of all records that have arrived."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _MARK.fields)
    return spark.read.schema(f"{fields}, batch string").parquet(f"{path}/marked").drop("batch")
