"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm import decontamination, host_rules, licenses, merkle, minhash, ranked_search, revisits, rule_ensemble, sentencepieces, simhash, surrogates, token_counts, toxicity
from qaloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Arrow batches handed to Python hold whole texts; they are bounded by bytes, not only by rows.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def query(build: Query) -> Query:
    """Register a query under the name of its function."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query
def op1_simhash(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", simhash.hex_column(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_host_rules(spark, d):
    judged = host_rules.judge(host_rules.document_counts(table(spark, d, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_failed",
    )


@query
def op7_token_counts(spark, d):
    return token_counts.token_counts(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_license_scan(spark, d):
    return licenses.license_labels(table(spark, d, "documents"))


@query
def op8_rule_ensemble(spark, d):
    return rule_ensemble.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op10_toxicity(spark, d):
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op5_decontamination(spark, d):
    return decontamination.contaminations(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op2_sentencepiece(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


#: The secret that surrogates are drawn with, here for tests; a job names its own.
PII_KEY = "test key"


@query
def op4_pii_surrogates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, PII_KEY, count="n_entities")


def warc_heads(pages: DataFrame) -> DataFrame:
    """(head): two WARC records of each page, a response and a later not-modified revisit, as header blocks.

    The revisits differ in their validators: strong, weak, wrong or missing ETags, or only a date; some
    come before any response.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))

    def stamp(seconds: F.Column, form: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> F.Column:
        return F.date_format(F.timestamp_seconds(F.lit(1704067200) + seconds), form)

    made = stamp(p * 60)
    response = F.concat_ws(
        "\n", F.lit("WARC/1.1"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: r"), p),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Date: "), made),
        F.concat(F.lit("WARC-Payload-Digest: md5:"), F.md5(F.coalesce("html", F.lit("")))), F.lit(""),
        F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html"), F.concat(F.lit("ETag: "), tag),
        F.concat(F.lit("Last-Modified: "), made), F.lit("Cache-Control: max-age=60"),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.coalesce("html", F.lit("")))),
    )
    sent = (
        F.when(p % 7 == 0, F.lit('ETag: "gone"')).when(p % 5 == 0, F.concat(F.lit("ETag: W/"), tag))
        .when((p % 3 == 0) | (p % 11 == 0), F.lit(None).cast("string")).otherwise(F.concat(F.lit("ETag: "), tag))
    )
    seen = p * 60 + F.when(p % 13 == 0, -86400 * 90).otherwise(86400 * 7)
    revisit = F.concat_ws(
        "\n", F.lit("WARC/1.1"), F.lit("WARC-Type: revisit"), F.concat(F.lit("WARC-Record-ID: v"), p),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Date: "), stamp(seen)),
        F.lit(f"WARC-Profile: {revisits.NOT_MODIFIED}"), F.lit(""),
        F.lit("HTTP/1.1 304 Not Modified"), sent, F.when(p % 3 == 0, F.concat(F.lit("Last-Modified: "), made)),
        F.lit("Cache-Control: max-age=120"), F.concat(F.lit("Date: "), stamp(seen)), F.lit("Content-Length: 0"),
        F.lit("Connection: close"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("head"))


@query
def op3_warc_revisits(spark, d):
    heads = warc_heads(table(spark, d, "pages"))
    resolved = revisits.resolve_revisits(revisits.parse_heads(heads))
    return resolved.select(
        "record_id", "canonical_url", "response_id", "outcome", revisits.header_text(F.col("headers")).alias("headers"), "digest"
    )


@query
def op11_merkle_manifest(spark, d):
    docs = table(spark, d, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", CAPITALS, CAPITALS.lower()))
    return merkle.verify(merkle.manifest(merkle.leaves(docs, tampered)))


@query
def op12_ranked_search(spark, d):
    return ranked_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op13_minhash(spark, d):
    return minhash.fingerprints(table(spark, d, "documents"))
