"""WARC: not-modified revisits resolved to the response they stand for.

A revisit record of a 304 answer has no payload. It is resolved by an as-of join: the
latest earlier full response of the same canonical URL. The validators of both must agree; then
the headers that a 304 may update are merged into those of the response.

The as-of join sorts records by range of (URL, time), so a URL with very many records spreads over
several ranges; the last response of each range is carried on to the later ranges of its URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.operators.skew import join_unique
from qaloom.session import cut

#: Header fields that a 304 answer may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
TRACKING = r"^(utm_\w+|gclid|fbclid)="


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, user, default port, tracking parameters and closing slash go; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    place = F.substring_index(bare, "?", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(place, "/", 1)), "^.*@", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(/.*)$", 1), "/+$", "")
    raw = F.when(F.instr(bare, "?") > 0, F.substring(bare, F.instr(bare, "?") + 1, F.length(bare))).otherwise(F.lit(""))
    wanted = F.array_sort(F.filter(F.split(raw, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise(F.lit("")))


def _fields(lines: Column) -> Column:
    """A map of header fields, names in lower case; of a repeated name the first line counts."""
    pairs = F.transform(
        F.filter(lines, lambda x: F.instr(x, ":") > 1),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")),
    )
    names = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))


def parse_heads(records: DataFrame, head: str = "head") -> DataFrame:
    """``records`` with the fields of their WARC and HTTP header blocks.

    Adds warc_type, record_id, url, at, profile, status and headers. The blocks stand one after the other with an
    empty line between. What is missing or cannot be read is null (headers: an empty map).
    """
    blocks = F.split(F.regexp_replace(F.coalesce(F.col(head), F.lit("")), "\r\n", "\n"), "\n\n")
    warc = _fields(F.split(F.get(blocks, F.lit(0)), "\n"))
    http = F.split(F.coalesce(F.get(blocks, F.lit(1)), F.lit("")), "\n")
    read = records.withColumn("__warc", warc).withColumn("__http", http)
    return read.withColumns({
        "warc_type": F.lower(F.col("__warc")["warc-type"]),
        "record_id": F.col("__warc")["warc-record-id"],
        "url": F.col("__warc")["warc-target-uri"],
        "at": F.try_to_timestamp(F.col("__warc")["warc-date"]),
        "profile": F.col("__warc")["warc-profile"],
        "digest": F.col("__warc")["warc-payload-digest"],
        "status": F.regexp_extract(F.get("__http", F.lit(0)), r"^HTTP/\S+ (\d{3})", 1).try_cast("int"),
        "headers": _fields(F.col("__http")),
    }).drop("__warc", "__http")


def latest_before(records: DataFrame) -> DataFrame:
    """(record_id, found): for each revisit the id of the latest response of its key at an earlier time, or null.

    ``records`` has key, at, record_id and is_response. Of responses at one time the one
    with the largest id counts; a response at the very time of the revisit is not earlier.
    """
    order = ["key", "at", "is_response", "record_id"]
    ranged = records.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    # Written once: the ranges must be the same wherever they are used below.
    ranged = cut(ranged)
    answer = F.when(F.col("is_response"), F.struct("at", "record_id"))
    inside = W.partitionBy("key", "part").orderBy("at", "is_response", "record_id").rowsBetween(W.unboundedPreceding, 0)
    near = ranged.withColumn("near", F.last(answer, ignorenulls=True).over(inside)).where(~F.col("is_response"))
    # One row per key and range: the last response there, and from it the last before each range.
    ends = ranged.groupBy("key", "part").agg(F.max(answer).alias("end"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("key", "part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = join_unique(near, carried, ["key", "part"])
    return found.select("record_id", F.coalesce("near", "carried")["record_id"].alias("found"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, response_id, outcome, headers, digest) of each not-modified revisit.

    ``records`` has the columns of ``parse_heads``. A full response has type response and status 200. Outcomes:
    ``resolved`` (validators agree; headers merged), ``mismatch`` (they differ), ``unvalidated`` (no validator on both
    sides), ``no_response`` (none earlier), ``unreadable`` (no URL or no time). ETags are compared weakly and
    decide if both sides have one; else Last-Modified does; a payload digest on both sides must be equal.
    Only resolved rows have headers and digest. Repeated rows (one record id) count once; records without an id
    are passed over; an empty table gives an empty result.
    """
    known = records.where(F.col("record_id").isNotNull()).select(
        "record_id", "warc_type", "profile", "status", "at", "headers", "digest", canonical_url(F.col("url")).alias("key")
    )
    known = cut(known.groupBy("record_id").agg(F.min_by(F.struct(
        "warc_type", "profile", "status", "at", "headers", "digest", "key"), F.struct("at", "key")).alias("r")).select("record_id", "r.*"))
    is_revisit = (F.col("warc_type") == "revisit") & ((F.col("profile") == NOT_MODIFIED) | (F.col("status") == 304))
    is_response = (F.col("warc_type") == "response") & (F.col("status") == 200)
    readable = F.col("key").isNotNull() & F.col("at").isNotNull()
    revisits, responses = known.where(is_revisit), known.where(is_response & readable)
    narrow = known.where((is_revisit | is_response) & readable).select(
        "key", "at", "record_id", is_response.alias("is_response"))
    found = latest_before(narrow)
    linked = join_unique(revisits, found, ["record_id"]).select(
        "record_id", "key", "at", F.col("headers").alias("update"), F.col("digest").alias("own_digest"), "found")
    stored = responses.select(F.col("record_id").alias("found"), F.col("headers").alias("stored"), "digest")
    both = join_unique(linked, stored, ["found"])

    def tag(side: str) -> Column:
        return F.regexp_replace(F.col(side)["etag"], "^W/", "")

    def date(side: str) -> Column:
        return F.col(side)["last-modified"]

    agree = F.coalesce(tag("update") == tag("stored"), date("update") == date("stored"))
    outcome = (
        F.when(F.col("key").isNull() | F.col("at").isNull(), "unreadable")
        .when(F.col("found").isNull(), "no_response")
        .when(F.col("own_digest") != F.col("digest"), "mismatch")
        .when(agree, "resolved").when(~agree, "mismatch").otherwise("unvalidated")
    )
    fresh = F.map_filter("update", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k))
    resolved = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", F.col("key").alias("canonical_url"), F.col("found").alias("response_id"), "outcome",
        F.when(resolved, F.map_concat(kept, fresh)).alias("headers"), F.when(resolved, F.col("digest")).alias("digest"),
    )


def header_text(headers: Column) -> Column:
    """Header fields as text, one to a line, in the order of their names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
