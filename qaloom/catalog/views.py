"""The review tables, derived from the given parquet tables.

Every view reads its whole source table, so the work of a query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.skew import join_unique

LEASE_MINUTES = 30
AS_OF = "2024-01-10 00:45:00"
TOOL_SCHEMA = """[{"name":"click","parameters":{"properties":{"k":{}},"required":["k"]}}, // first
{"type":"function","function":{"name":"view","description":"shows /* all */","parameters":{"properties":{"k":{"type":"int","description":"key"},"v":{"type":"int"}},"required":["k","v",]}}},{"name":"purchase","parameters":{"properties":{"amount":{}},"required":["amount","ghost"]}},{"name":"error","parameters":{}}]"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    # As a pattern, the path may be one file or a folder of part files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def after(start: str, seconds: Column) -> Column:
    """A timestamp some seconds after a fixed moment (UTC)."""
    return F.timestamp_seconds(F.unix_timestamp(at(start)) + seconds)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn that an assistant turn follows, with its conversation's system text.

    The pairing is an equi-join on (conversation, turn), a unique key, so a very
    long conversation is no hot window.
    """
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", "text")
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.max("text").alias("system"))
    paired = join_unique(users.join(answers, ["conv_id", "turn"]), system, ["conv_id"])
    return paired.select(
        (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("position"),
        F.col("conv_id").cast("string").alias("source_id"),
        F.coalesce("system", F.lit("")).alias("instruction"),
        F.array("text").alias("input"),
        "output",
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per document source; every tenth is still open."""
    number = F.expr("cast(substr(source, 4) as bigint)")
    return (
        table(spark, sf_dir, "documents").groupBy("source")
        .agg(F.count(F.lit(1)).alias("imported_count"))
        .select(
            number.alias("id"),
            F.concat("source", F.lit(".json")).alias("filename"),
            F.sha2("source", 256).alias("file_hash"),
            after("2024-01-01 00:00:00", number * 3600).alias("uploaded_at"),
            "imported_count",
            F.lit(0).cast("bigint").alias("skipped_count"),
            F.when(number % 10 == 9, "uploading").otherwise("ready").alias("status"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_questions(table(spark, sf_dir, "documents"))


def as_questions(documents: DataFrame) -> DataFrame:
    """Every document as a question; the output is its text without stops and commas."""
    return documents.select(
        F.col("doc_id").alias("id"),
        F.expr("cast(substr(source, 4) as bigint)").alias("batch_id"),
        (F.col("doc_id") % 500).cast("string").alias("source_id"),
        F.col("lang").alias("instruction"),
        F.array("text").alias("input"),
        F.translate("text", ".,", "").alias("output"),
    )


def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_records(as_questions(table(spark, sf_dir, "documents")))


def as_records(asked: DataFrame) -> DataFrame:
    """Questions in the shape the checker reads."""
    return asked.select(
        F.col("id").alias("position"), "source_id", "instruction", "input", "output"
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_reviews(table(spark, sf_dir, "labels"))


def as_reviews(labels: DataFrame) -> DataFrame:
    return labels.select(
        (F.col("doc_id") + 1).alias("id"),
        F.col("doc_id").alias("question_id"),
        F.when(F.col("quality") == 1, "Pass").otherwise("Fail").alias("decision"),
        F.when(F.col("quality") == 1, "").when(F.col("toxic") == 1, "toxic")
        .otherwise("low quality").alias("notes"),
        F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string")).alias("reviewer"),
        after("2024-01-01 00:00:00", F.col("doc_id") * 420).alias("reviewed_at"),
    )


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lease per supplier, on the question of the same number.

    Some stand on reviewed questions, some have run out, some end exactly at AS_OF.
    """
    key = F.col("s_suppkey")
    seen = (key % 60) * 60
    return table(spark, sf_dir, "supplier").select(
        key.alias("question_id"),
        F.concat(F.lit("r"), (key % 7).cast("string")).alias("reviewer"),
        F.concat(F.lit("s"), (key % 11).cast("string")).alias("session_id"),
        after("2024-01-10 00:00:00", seen).alias("assigned_at"),
        after("2024-01-10 00:00:00", seen).alias("last_activity_at"),
        after("2024-01-10 00:00:00", seen + LEASE_MINUTES * 60).alias("lease_expires_at"),
    )


def tool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tool call against one schema with a comment and loose commas."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("position"),
        F.col("event_id").cast("string").alias("source_id"),
        F.when(F.col("event_id") % 17 == 0, "no tools").otherwise(TOOL_SCHEMA).alias("instruction"),
        F.array("event_type").alias("input"),
        F.when(F.col("event_id") % 10 == 0, "no call").otherwise(
            F.concat(
                F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props",
                F.lit(",}</tool_call>"),
            )
        ).alias("output"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request for a question by its user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("claim_id"),
        F.concat(F.lit(" r"), F.col("user_id").cast("string")).alias("reviewer"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("session_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("exclude_question_id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a reviewer's action on the question of its customer number."""
    cust = F.col("o_custkey")
    wrong = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        cust.alias("question_id"),
        F.concat(F.lit("r"), (cust % 7).cast("string"), F.lit(" ")).alias("reviewer"),
        F.concat(F.lit("s"), ((cust + wrong) % 11).cast("string")).alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", "Fail").when(F.col("o_orderstatus") == "O", "Pass")
        .otherwise("Maybe").alias("decision"),
        F.when(F.col("o_totalprice") > 250000, " costly ").otherwise("  ").alias("notes"),
        after("2024-01-10 00:30:00", (F.col("o_orderkey") % 60) * 60).alias("requested_at"),
    )


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lease_events(table(spark, sf_dir, "events"))


def as_lease_events(events: DataFrame) -> DataFrame:
    """The event table as a log of review actions, in event order, one per second."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    action = (
        F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "view", "renew")
        .when(F.col("event_type") == "error", "skip").otherwise("submit")
    )
    return events.select(
        "event_id",
        after("2024-01-01 00:00:00", F.col("event_id")).alias("at"),
        (F.col("user_id") * 10 + F.floor(k / 10)).alias("question_id"),
        F.concat(F.lit("r"), (k % 2).cast("string")).alias("reviewer"),
        F.lit("s").alias("session_id"),
        action.alias("action"),
        F.when(F.col("event_type") == "purchase", "Fail").when(F.col("event_type") == "click", "Pass")
        .alias("decision"),
        F.when(F.col("event_type") == "purchase", "wrong").otherwise("").alias("notes"),
    )


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_texts(table(spark, sf_dir, "events"))


def as_raw_texts(events: DataFrame) -> DataFrame:
    """Every event as the JSON text of an upload record; most kinds have a flaw.

    A user's events form one file.
    """
    head = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"))
    text = (
        F.when(F.col("event_type") == "click", F.concat(
            head, F.lit(', "instruction": "i", "input": ["a", "b"], "output": "ok", "more": '),
            "props", F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(
            head, F.lit(', "instruction": "i", "input": "one"}')))
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit('{"id": '), F.col("value").cast("decimal(12,1)").cast("string"),
            F.lit(', "instruction": "i", "input": "one", "output": "ok"}')))
        .when(F.col("event_type") == "signup", F.concat(
            head, F.lit(', "instruction": "i", "input": ["a", '), "props", F.lit('], "output": "ok"}')))
        .otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    )
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".json")).alias("filename"),
        (F.col("event_id") + 1).alias("row"), text.alias("line"),
    )


def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, status) of the uploads of the raw texts: half are open, a quarter is ready, a quarter not known."""
    known = table(spark, sf_dir, "events").where("user_id % 4 <> 3").select(F.col("user_id").alias("id")).distinct()
    return known.withColumn("status", F.when(F.col("id") % 4 == 2, "ready").otherwise("uploading"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_texts(spark, sf_dir).withColumn("record", F.try_parse_json("line")).drop("line")


def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the raw texts; every fourth has the content of the one before it."""
    number = F.expr("cast(substr(file, 2) as bigint)")
    return raw_texts(spark, sf_dir).select("file", "filename").distinct().withColumn(
        "file_hash", F.sha2((number - (number % 4 == 3).cast("bigint")).cast("string"), 256)
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the text of an upload document; most kinds cannot be read or hold no data."""
    n = F.col("row") - 1
    line = F.col("line")
    text = (
        F.when(n % 7 == 0, F.concat(F.lit('{"data": ['), line, F.lit("]}")))
        .when(n % 7 == 1, F.concat(F.lit('{"x": {"data": 1}, "data": ['), line, F.lit(", 5, "), line, F.lit("]}\n")))
        .when(n % 7 == 2, F.concat(F.lit('{"rows": ['), line, F.lit("]}")))
        .when(n % 7 == 3, F.concat(F.lit("["), line, F.lit("]")))
        .when(n % 7 == 4, F.concat(F.lit('{"data": ['), line, F.lit("]")))
        .when(n % 7 == 5, F.concat(F.lit('{"data": []}'), line))
        .otherwise(F.concat(F.lit("\ufeff"), F.lit('{"data": ["'), n.cast("string"), F.lit('"]}')))
    )
    return raw_texts(spark, sf_dir).select(n.alias("event_id"), text.alias("text"))


LINES_PER_FILE = 5000


def json_lines_files(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Every event as a line of a JSON Lines file, written under ``path``; some lines are blank, broken or two values.

    Returns the pattern that names the files; a file holds 5,000 events in order.
    """
    n, line = F.col("row") - 1, F.col("line")
    text = (
        F.when(n % 13 == 0, F.lit("")).when(n % 11 == 0, F.concat(line, F.lit("}")))
        .when(n % 19 == 0, F.concat(line, F.lit(" "), line)).when(n % 23 == 0, F.concat(line, F.lit("\r"))).otherwise(line)
    )
    up = F.expr(f"(row - 1) div {LINES_PER_FILE}")
    placed = raw_texts(spark, sf_dir).select(up.alias("up"), "row", text.alias("value"))
    ordered = placed.repartition("up").sortWithinPartitions("up", "row").drop("row")
    ordered.write.mode("overwrite").partitionBy("up").text(path)
    return f"{path}/up=*"
