"""Quality rules per document and per host, with DataFrame functions only.

Every document gets counts and two base rules. A further rule set looks for signs of junk;
how often a host breaks it is shrunk towards the rate of all hosts with a beta prior whose two
parameters are fitted to the hosts' rates by moments. A host whose shrunk rate passes a
limit is judged as a whole, and the verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.session import cut

#: What stands between words: ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, largest share (per cent) of words in repeated windows.
LEAST_WORDS, REPEAT_SHARE = 50, 50
#: Signs of junk: symbols per hundred characters of words, repeated lines per hundred lines.
SYMBOL_SHARE, LINE_SHARE = 10, 30
#: A host with a shrunk failure rate over this is refused. A prior is worth 1 to 10,000 documents.
HOST_LIMIT = 0.5
LEAST_PRIOR, MOST_PRIOR = 1.0, 10_000.0


def _repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the same list.

    Windows are sorted with their positions, so equal ones are neighbours; the
    positions of those, sorted again, cover ``min(3, distance to the next)`` words each.
    That takes n log n steps however often a window occurs.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )

    def again(s: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(s, i - 1)["h"], F.get(s, i + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x)

    # One-element arrays bind a computed list to a name, so it is computed once.
    found = F.get(F.transform(F.array(F.sort_array(windows)), again), F.lit(0))
    counted = F.get(F.transform(F.array(found), covered), F.lit(0))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(counted)


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, junk).

    A null or empty text has no words and fails the base rules. Null hosts are a host of their own.
    Counts are those of the whole text.
    """
    held = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    listed = held.select(
        "doc_id", "host", "text",
        F.filter(F.split("text", GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = listed.select(
        "doc_id", "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
    )
    return counted.withColumn("base_failed", F.expr(
        f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_SHARE} * n_words"
    )).withColumn("junk", F.expr(
        f"base_failed or 100 * n_symbols > {SYMBOL_SHARE} * word_chars or 100 * n_dup_lines > {LINE_SHARE} * n_lines"
    ))


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, n_docs, n_junk, rate, host_failed): one row per host, its rate shrunk.

    The prior is a beta distribution with the mean m of all documents. With v the variance of the
    hosts' own rates and e the part of it that chance explains, its weight is
    m (1 - m) / (v - e) - 1, within bounds; no spread beyond chance gives the upper bound.
    """
    hosts = counted.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("junk").alias("n_junk")
    )
    share = F.col("n_junk") / F.col("n_docs")
    moments = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_junk").alias("k"),
        F.sum(share).alias("s1"), F.sum(share * share).alias("s2"),
        F.sum(1.0 / F.col("n_docs")).alias("inv"), F.count(F.lit(1)).alias("hosts"),
    ).select(
        (F.col("k") / F.col("n")).alias("m"),
        (F.col("s2") / F.col("hosts") - F.pow(F.col("s1") / F.col("hosts"), F.lit(2.0))).alias("v"),
        (F.col("inv") / F.col("hosts")).alias("inv"),
    ).selectExpr(
        "m",
        f"case when v - m * (1 - m) * inv <= 0 then {MOST_PRIOR}D "
        f"else greatest({LEAST_PRIOR}D, least({MOST_PRIOR}D, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) end as weight",
    )
    # The prior is one row, joined by a constant key.
    keyed = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(moments.withColumn("_one", F.lit(1))), "_one")
    rate = (F.col("n_junk") + F.col("weight") * F.col("m")) / (F.col("n_docs") + F.col("weight"))
    return keyed.select("host", "n_docs", "n_junk", F.round(rate, 6).alias("host_rate"), (rate > HOST_LIMIT).alias("host_failed"))


def judge(counted: DataFrame) -> DataFrame:
    """``document_counts`` with host_rate, host_failed and kept, the verdict.

    A document is kept if it passes the base rules and its host is not refused. An empty
    table gives an empty result; repeated rows are counted and judged as often as they stand.
    """
    counted = cut(counted)
    verdicts = host_rates(counted).select(
        F.col("host").alias("_host"), F.xxhash64("host").alias("_near"), "host_rate", "host_failed"
    )
    # The digest gives the aggregated side an exchange of its own, so that a hot host can be split.
    joined = counted.withColumn("_spread", F.xxhash64("host")).join(
        verdicts, (F.col("_spread") == F.col("_near")) & F.col("host").eqNullSafe(F.col("_host")), "left"
    ).drop("_host", "_near", "_spread")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
