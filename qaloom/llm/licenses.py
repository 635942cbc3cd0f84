"""License scan by diagonal voting, with DataFrame functions only.

All rolling word 3-grams of every text are joined by their hash (and, against
collisions, their words) to the positions of the same grams in the license templates. Hits of one text and
template on one diagonal (text position less template position) belong to one stretch; a word more
or less shifts it to a neighbouring diagonal, so close diagonals are merged. A merged
span is verified by the template words it covers and by its length in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Base phrases, by label.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Stretches of license texts and notices, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "commons attribution noncommercial 4 0 international"),
    ("cc-by", "commons attribution 4 0 international"),
    ("cc-by-sa", "commons attribution sharealike 4 0 international"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
GRAM = 3
#: Diagonals this close are one span; it must cover this share of the template's words, and be no longer than so many times the template.
SLACK, COVERED, STRETCH = 2, 0.85, 1.5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams() -> list[tuple]:
    """(template, label, is_base, n, tpos, gram) of every gram of every template; a few hundred rows."""
    out = []
    for number, (label, text) in enumerate(BASE + TEMPLATES):
        words = text.split()
        for at in range(len(words) - GRAM + 1):
            gram = " ".join(words[at:at + GRAM])
            out.append((number, label, number < len(BASE), len(words), at, gram))
    return out


def word_list(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: runs of letters, digits and anything beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def gram_hits(docs: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, template, label, is_base, n, tpos, diagonal): every gram of a text found in a template."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - GRAM),
        lambda i: F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(GRAM)]),
    )
    rolled = docs.where(F.size(words) >= GRAM).select(*keys, F.posexplode(grams).alias("pos", "gram"))
    templates = docs.sparkSession.createDataFrame(
        template_grams(), "template int, label string, is_base boolean, n int, tpos int, gram string"
    ).withColumn("hash", F.xxhash64("gram"))
    # The templates are the fixed list above, so the broadcast does not grow.
    hits = rolled.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(templates), ["hash", "gram"])
    return hits.select(*keys, "template", "label", "is_base", "n", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))


def spans(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, template, label, is_base, places, first, last, coverage): merged and verified spans.

    ``places`` lists the starts of unbroken occurrences of the whole template.
    """
    votes = hits.groupBy(*keys, "template", "label", "is_base", "n", "diagonal").agg(
        F.collect_set("tpos").alias("at")
    )
    order = W.partitionBy(*keys, "template").orderBy("diagonal")
    runs = votes.withColumn("new", F.coalesce(
        (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(0)
    )).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy(*keys, "template", "label", "is_base", "n", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("at") + GRAM - 1).alias("last"),
        F.collect_list(F.when(F.size("at") == F.col("n") - GRAM + 1, F.col("diagonal"))).alias("places"),
    )
    reached = F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + GRAM - 1))))
    return merged.select(
        *keys, "template", "label", "is_base", "n", "places", "first", "last", (F.size(reached) / F.col("n")).alias("coverage")
    )


def license_labels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    A null or empty text has no words, no places, empty labels and score 0. ``score`` is the largest
    covered share of any template. Repeated rows get the same result each; other columns are
    ignored; an empty table gives an empty result.
    """
    keys = ["doc_id", "digest", "size"]
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = held.select(
        "doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"),
        word_list(F.col("text")).alias("words"),
    )
    found = spans(gram_hits(keyed, keys), keys)
    accepted = (F.col("coverage") >= COVERED) & (F.col("last") - F.col("first") + 1 <= STRETCH * F.col("n"))
    base = F.when(F.col("is_base") & (F.size("places") > 0), F.col("label"))
    starts = F.when(F.col("is_base"), F.col("places")).otherwise(F.array().cast("array<int>"))
    each = found.groupBy(*keys).agg(
        F.sum(F.size(starts)).cast("bigint").alias("n_base"),
        F.min(F.array_min(starts)).cast("bigint").alias("first_word"),
        F.max(F.array_max(starts)).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce(base, F.when(accepted, F.col("label"))))), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = keyed.select(*keys, F.size("words").cast("bigint").alias("n_words"))
    same = [counted[k].eqNullSafe(each[k]) for k in keys]
    joined = counted.join(each, same[0] & same[1] & same[2], "left")
    return joined.select(
        counted["doc_id"], "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )
