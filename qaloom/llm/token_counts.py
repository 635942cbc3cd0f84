"""Token counts under a byte-level BPE with word ends, without encoding each text.

Words between white space are counted once per batch of texts: their pre-tokens lie end to end in
one ragged numpy array of symbols, and in every round each sequence applies its
pair of lowest rank, all sequences at once, until no pair of any has a rank. What is left of a
sequence is its number of tokens. A text's count is the sum over its words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).max
#: Words whose counts a task remembers; past that it starts anew.
REMEMBERED = 700_000
#: Fixed values of the vocabulary file: pre-token pattern and the white space of its first step.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The tables of one vocabulary file: symbols of bytes, ranks and products of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, vocab = held["model"], held["model"]["vocab"]
        letters, end = _byte_letters(), model["end_of_word_suffix"]
        self.specials = [t["content"] for t in held["added_tokens"] if t["special"]]
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.width = len(vocab)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
        codes = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks, self.product = codes[order], order, pairs[:, 2]
        # A rank whose product is part of a pair of lower rank is applied one place at a time.
        first_use = np.full(self.width, NONE)
        rank = np.arange(len(pairs))
        np.minimum.at(first_use, pairs[:, 0], rank)
        np.minimum.at(first_use, pairs[:, 1], rank)
        self.at_once = first_use[self.product] > rank

    def rank_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (none of them empty) when no pair can be merged."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.inner[data]
        symbols[ends] = self.last[data[ends]]
        left = lengths.copy()
        rows = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            pair = np.full(len(symbols), NONE)
            joined = rows[:-1] == rows[1:]
            pair[:-1][joined] = self.rank_of((symbols[:-1] * self.width + symbols[1:])[joined])
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sizes = np.diff(np.r_[starts, len(rows)])
            lowest = np.minimum.reduceat(pair, starts)
            left[rows[starts]] = sizes
            live = np.repeat(lowest != NONE, sizes)
            symbols, rows, pair = symbols[live], rows[live], pair[live]
            if not len(symbols):
                break
            lowest = np.repeat(lowest[lowest != NONE], sizes[np.minimum.reduceat(live, starts)])
            chosen = pair == lowest
            # Of pairs that overlap (a run of one symbol) every second is taken, from the left.
            place = np.arange(len(chosen))
            fresh = chosen & ~np.r_[False, chosen[:-1] & joined_rows(rows)]
            begin = np.maximum.accumulate(np.where(fresh, place, 0))
            chosen &= (place - begin) % 2 == 0
            single = chosen & ~self.at_once[np.where(chosen, pair, 0)]
            if single.any():
                where = np.flatnonzero(single)
                again = where[1:][rows[where[1:]] == rows[where[:-1]]]
                chosen[again] = False
            at = np.flatnonzero(chosen)
            symbols[at] = self.product[pair[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, rows = symbols[stays], rows[stays]
        return left


def joined_rows(rows: np.ndarray) -> np.ndarray:
    return rows[1:] == rows[:-1]


class Counter:
    """Counts of texts, with the words seen so far remembered."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials)))
        self.space = regex.compile(r"\s+")
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def _words(self, text: str) -> tuple[list[str], int]:
        """The words of a text, and the number of special strings in it."""
        parts = self.special.split(text) if "<|" in text else [text]
        words: list[str] = []
        for part in parts:
            odd = any(c in part for c in ODD_SPACE)
            words += [w for w in self.space.split(part) if w] if odd else part.split()
        return words, len(parts) - 1

    def _learn(self, words: list[str]) -> None:
        split, upper = self.pattern.findall, "Σ"
        listed = []
        for word in words:
            if not word.isascii():
                word = unicodedata.normalize("NFC", word).replace(upper, "σ")
            word = word.lower()
            listed.append((word,) if word.isalpha() else split(word))
        fresh = list({x for pieces in listed for x in pieces}.difference(self.pieces))
        if fresh:
            counts = self.merges.count([x.encode("utf-8", "replace") for x in fresh])
            self.pieces.update(zip(fresh, counts.tolist()))
        of = self.pieces.__getitem__
        self.known.update(zip(words, [sum(map(of, pieces)) for pieces in listed]))

    def count(self, texts: list[str | None]) -> list[int]:
        listed = [self._words(t or "") for t in texts]
        fresh = {w for words, _ in listed for w in words}.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.pieces = {}, {}
            fresh = {w for words, _ in listed for w in words}
        self._learn(list(fresh))
        known = self.known
        return [sum(map(known.__getitem__, words)) + special for words, special in listed]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``vocabulary`` is the path of the vocabulary file on the executors. A null text counts
    as empty: 0 bytes and 0 tokens. Repeated rows are counted each; other columns are ignored; an empty
    table gives an empty result. Special strings inside a text are one token each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            counts = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    held = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    kind = dict(held.dtypes)["doc_id"]
    counted = held.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
