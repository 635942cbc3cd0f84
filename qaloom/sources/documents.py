"""Reading upload documents and JSON Lines files into raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.functions import validation as v

# Refusal messages of a whole file.
NOT_JSON = "The uploaded file is not valid UTF-8 JSON."
NO_DATA = "The JSON root must contain a 'data' array."

# A document is read inside a wrapper whose last field shows that nothing followed
# it: the JSON reader of Spark stops quietly after the first value.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _wrapped(text: Column, inner: str) -> Column:
    body = F.concat(F.lit('{"value":'), text, F.lit(',"end of text":1}'))
    return F.from_json(body, f"value {inner}, `end of text` int", _STRICT)


def _whole(parsed: Column, text: Column) -> Column:
    """Whether the text is one JSON value and nothing else.

    Beside the closing field, the wrapper must hold nothing that the text has put there. For
    that it is read once more with field names made from the text's own digest, which no text can hold.
    """
    digest = F.sha2(text, 256)
    body = F.concat(F.lit('{"'), digest, F.lit('":'), text, F.lit(',"end '), digest, F.lit('":1}'))
    names = F.map_keys(F.from_json(body, "map<string,string>", _STRICT))
    alone = names == F.array(digest, F.concat(F.lit("end "), digest))
    return F.coalesce(parsed["end of text"] == 1, F.lit(False)) & F.coalesce(alone, F.lit(False))


def parse_documents(files: DataFrame, text: str = "text") -> DataFrame:
    """Add ``data`` (an array of JSON values) or ``error`` to each file.

    The elements are separate values, so only a single record is limited in size,
    not the document.
    """
    plain = F.regexp_replace(text, r"^\x{FEFF}", "")
    return (
        files.withColumn("_plain", plain)
        .withColumn("_doc", _wrapped(F.col("_plain"), "struct<data array<variant>>"))
        .withColumn("data", F.when(_whole(F.col("_doc"), F.col("_plain")), F.col("_doc.value.data")))
        .withColumn(
            "error",
            F.when(F.col("data").isNotNull(), F.lit(None))
            .when(_whole(_wrapped(F.col("_plain"), "variant"), F.col("_plain")), NO_DATA)
            .otherwise(NOT_JSON),
        )
        .drop("_plain", "_doc")
    )


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole JSON files: file, filename, file_hash, data, error; one row per file.

    A file is one task, so a load scales by its number of files. A single very
    large upload belongs in JSON Lines, which splits. Spark passes over files of
    zero bytes, so those give no row.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.sha2("content", 256).alias("file_hash"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    )
    return parse_documents(files).drop("text")


def raw_records(documents: DataFrame) -> DataFrame:
    """One row per element of ``data`` of every readable file, 1-based ``row``."""
    kept = [c for c in documents.columns if c not in ("data", "error")]
    rows = documents.select(*kept, F.posexplode("data").alias("_ix", "record"))
    return rows.withColumn("row", F.col("_ix").cast("bigint") + 1).drop("_ix")


def refused_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("error").isNotNull()).select("file", "filename", "error")


#: Digests under one digest of the next level, and levels above the lines.
FAN, LEVELS = 1024, 3


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of text files, blank ones too: file, filename, size (of the file in bytes), row (from 1), line.

    Lines end at a line feed, so a carriage return stays part of its line. A large file is read in blocks by many tasks: lines count up
    within their block, and the lines of the blocks before it are added.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"), F.col("value").alias("line"),
    )
    blocks = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(starts, ["file", "_block"]).select(
        "file", "filename", "size", (F.col("_order") - F.col("_first") + F.col("_start") + 1).alias("row"), "line")


def lines_files(lines: DataFrame) -> DataFrame:
    """One row per file of ``read_lines``: file, filename, lines, file_hash.

    The digest is the top of a hash tree: SHA-256 of each line, of each block of ``FAN`` line digests in order, and so on for
    ``LEVELS`` levels; what remains is hashed together with the file's size, which tells whether the last line is ended. No task sees more
    of a file than one block of digests, and two files have one digest only if their bytes are equal.
    """
    own = ["file", "filename", "size"]

    def joined(order: str) -> Column:
        held = F.array_sort(F.collect_list(F.struct(order, "_digest")))
        return F.sha2(F.array_join(F.transform(held, lambda x: x["_digest"]), ""), 256).alias("_digest")

    level = lines.select(*own, (F.col("row") - 1).alias("_at"), F.sha2(F.col("line").cast("binary"), 256).alias("_digest"), F.lit(1).alias("_n"))
    for _ in range(LEVELS):
        level = level.groupBy(*own, F.expr(f"_at div {FAN}").alias("_up")).agg(
            joined("_at"), F.sum("_n").alias("_n")).withColumnRenamed("_up", "_at")
    top = level.groupBy(*own).agg(joined("_at"), F.sum("_n").alias("lines"))
    return top.select("file", "filename", "lines", F.sha2(F.concat_ws(":", "size", "_digest"), 256).alias("file_hash"))


def json_lines(lines: DataFrame) -> DataFrame:
    """The records of ``read_lines``: file, filename, row (the line's number), record; blank lines have none."""
    plain = F.regexp_replace("line", r"^\x{FEFF}", "")
    held = lines.where(F.col("line").rlike(r"\S")).withColumn("_parsed", _wrapped(plain, "variant"))
    return held.select("file", "filename", "row", F.when(_whole(F.col("_parsed"), plain), F.col("_parsed.value")).alias("record"))


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON Lines files, one record per line, numbered by line."""
    return json_lines(read_lines(spark, path))


def validated(raw: DataFrame, profile: str = "store") -> DataFrame:
    """Add ``message``: why a record is refused, or null."""
    unreadable = F.when(F.col("record").isNull(), NOT_JSON)
    return raw.withColumn("message", F.coalesce(unreadable, v.error_message(F.col("record"), profile)))


def fields(valid: DataFrame) -> DataFrame:
    """Valid raw records as typed columns."""
    r = F.col("record")
    kept = [c for c in valid.columns if c not in ("record", "message")]
    return valid.select(
        *kept, v.source_id(r).alias("source_id"),
        F.try_variant_get(r, "$.instruction", "string").alias("instruction"),
        v.parts(r).alias("input"),
        F.try_variant_get(r, "$.output", "string").alias("output"),
    )


def load_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to check, malformed rows), per file when there is a ``file``.

    ``position`` counts the valid records of a file from 0, which is how a record
    is told apart even when two share an id.
    """
    judged = validated(raw, "checker")
    malformed = judged.where(F.col("message").isNotNull()).select(
        *[c for c in judged.columns if c == "file"],
        v.label(F.col("record"), F.col("row")).alias("source_id"),
        F.col("message").alias("reason"),
    )
    return position_valid(judged), malformed


def position_valid(judged: DataFrame, block: int = 100_000) -> DataFrame:
    """Typed valid records with their dense 0-based position among the valid ones.

    Rows are numbered inside blocks of bounded size; only the counts of the blocks
    pass through a window over a whole file.
    """
    files = [c for c in judged.columns if c == "file"]
    cut = judged.where(F.col("message").isNull()).withColumn("_block", F.floor(F.col("row") / block))
    counts = cut.groupBy(*files, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*files).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*files, "_block").orderBy("row")
    placed = cut.join(starts, [*files, "_block"]).withColumn(
        "position", (F.row_number().over(inside) - 1 + F.col("_start")).cast("bigint")
    )
    return fields(placed.drop("_block", "_start", "row"))


def preview_counts(judged: DataFrame) -> DataFrame:
    """Valid and skipped rows per file."""
    return judged.groupBy("file").agg(
        F.count_if(F.col("message").isNull()).alias("valid_count"),
        F.count_if(F.col("message").isNotNull()).alias("skipped_count"),
    )


def preview(documents: DataFrame, profile: str = "store") -> tuple[DataFrame, DataFrame]:
    """(counts per readable file, refused rows) of an upload, with nothing stored."""
    judged = validated(raw_records(documents), profile)
    readable = documents.where(F.col("error").isNull()).select("file", "filename")
    counts = readable.join(preview_counts(judged), "file", "left")
    return (
        counts.fillna(0, ["valid_count", "skipped_count"]),
        judged.where(F.col("message").isNotNull()).select("file", "row", "message"),
    )
