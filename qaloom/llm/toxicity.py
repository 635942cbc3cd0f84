"""Toxicity classifier: bags of subwords, averaged into a linear softmax.

A word is the bag of its character n-grams (with marks of its ends). The bag's embeddings
are averaged and a linear softmax tells toxic from other words; embeddings and softmax are trained jointly in
numpy, so a misspelling that was never seen shares the vectors of the n-grams it keeps. Only documents are
labelled: training starts with every word under its document's label, and then keeps of a
toxic document only the words that stand out. A document is scored by the words that
stand out most, so its length does not thin out a few of them; a second, two-class logistic
step on those, fitted on words the model was not trained with, turns this into a probability.

After training, the softmax of an average is the average of one number per n-gram, so what
travels to the tasks is a fixed table of ``BUCKETS`` numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import samples

FOLDS, HELD_OUT = 4, 2
#: The labelled sample is bounded in documents and in bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16_000_000
LEAST, MOST = 3, 6
BUCKETS, WIDTH = 1 << 18, 4
#: Training: rounds, steps in each, rate, documents that an n-gram needs to speak freely, weight of a standing-out word.
ROUNDS, STEPS, RATE, SUPPORT, BOOST = 3, 25, 6.0, 4.0, 4.0
#: Words whose n-grams are laid out at once; all words of the sample are trained on, in as many batches as they need.
CHUNK = 50_000
THRESHOLD = 0.3
TOP = 3
#: Words whose score a task remembers; past that it starts anew.
REMEMBERED = 500_000
#: A longer run without a break is looked at in pieces, so one odd word cannot take all memory.
LONGEST = 64
WORD = re.compile(r"[^\W_]+(?:['@$!*][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    """The words of a whole text in lower case; an overlong word gives several."""
    found = WORD.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of every word, where each word's begin): ragged arrays.

    The whole word, with its end marks, is an n-gram too, so no bag is empty.
    """
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    room = lengths[owner] - place
    prime = np.uint64(1099511628211)
    rolled = np.full(len(codes), 14695981039346656037, np.uint64)
    buckets, owners = [], []
    for n in range(1, MOST + 1):
        shifted = np.zeros(len(codes), np.uint64)
        if n <= len(codes):
            shifted[: len(codes) - n + 1] = codes[n - 1:]
        rolled = (rolled ^ shifted) * prime
        if n >= LEAST:
            fits = room >= n
            mixed = rolled[fits] ^ (rolled[fits] >> np.uint64(29))
            buckets.append((mixed * prime >> np.uint64(40)) % np.uint64(BUCKETS))
            owners.append(owner[fits])
    whole = np.bitwise_xor.reduceat(codes * (place.astype(np.uint64) * np.uint64(2654435761) + prime),
                                    np.cumsum(lengths) - lengths) if len(codes) else np.zeros(0, np.uint64)
    buckets.append((whole * prime >> np.uint64(40)) % np.uint64(BUCKETS))
    owners.append(np.arange(len(words)))
    all_buckets, all_owners = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    counts = np.bincount(all_owners, minlength=len(words))
    return all_buckets[order], np.cumsum(counts) - counts


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``ngrams`` of any number of words, made in batches and held in four bytes each."""
    made = [ngrams(words[k:k + CHUNK]) for k in range(0, max(len(words), 1), CHUNK)]
    ends = np.cumsum([0, *(len(b) for b, _ in made)])
    return np.concatenate([b.astype(np.int32) for b, _ in made]), np.concatenate([s + e for (_, s), e in zip(made, ends)])


def batches_of(starts: np.ndarray, total: int) -> Iterator[tuple[slice, slice]]:
    """(words, n-grams) of each batch."""
    for k in range(0, len(starts), CHUNK):
        end = starts[k + CHUNK] if k + CHUNK < len(starts) else total
        yield slice(k, min(k + CHUNK, len(starts))), slice(starts[k], end)


def averages(table: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The average number of each bag."""
    sizes = np.diff(np.r_[starts, len(buckets)])
    return np.concatenate([np.zeros(0)] + [
        np.add.reduceat(table[buckets[grams]], starts[own] - grams.start) / sizes[own] for own, grams in batches_of(starts, len(buckets))])


@dataclass(frozen=True)
class Model:
    """One number per n-gram bucket, the bias of a word, and the step from words to a document."""

    table: np.ndarray
    bias: float
    weights: tuple[float, ...]
    intercept: float

    def words(self, words: list[str]) -> np.ndarray:
        """The log-odds of toxic of each word."""
        if not words:
            return np.zeros(0)
        buckets, starts = bags(words)
        return averages(self.table, buckets, starts) + self.bias

    def document(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.intercept, -35, 35)))


def features(tops: list[list[float]]) -> np.ndarray:
    """Per document: log-odds of its most toxic word, mean of the next ones; a missing word counts as -8."""
    padded = [sorted(t, reverse=True)[:TOP] + [-8.0] * (TOP - len(t)) for t in tops]
    held = np.clip(np.array(padded, np.float64).reshape(-1, TOP), -8, 8)
    return np.c_[held[:, 0], held[:, 1:].mean(1)]


def train_words(buckets: np.ndarray, starts: np.ndarray, positive: np.ndarray, negative: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Jointly train embeddings and softmax on words with weights of both labels; (number per bucket, bias).

    A step moves an n-gram by its mean slope, held back where few documents speak for it.
    """
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    sizes = np.diff(np.r_[starts, len(buckets)])
    embed = rng.normal(0, 0.01, (len(used), WIDTH))
    soft = np.sqrt(1 / WIDTH) * np.stack([-np.ones(WIDTH), np.ones(WIDTH)], 1) + rng.normal(0, 0.05, (WIDTH, 2))
    bias = np.zeros(2)
    weight = np.c_[negative, positive]
    total = weight.sum(1)
    local = place[buckets]
    support = np.zeros(len(used))
    for own, grams in batches_of(starts, len(buckets)):
        support += np.bincount(local[grams], np.repeat(total[own] / sizes[own], sizes[own]), len(used))
    held_back = (RATE / (support + SUPPORT))[:, None]
    for _ in range(STEPS):
        moved, turned, shifted = np.zeros_like(embed), np.zeros_like(soft), np.zeros(2)
        for own, grams in batches_of(starts, len(buckets)):
            at, size = local[grams], sizes[own]
            mean = np.stack([np.add.reduceat(embed[:, k][at], starts[own] - grams.start) for k in range(WIDTH)], 1) / size[:, None]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = p * total[own, None] - weight[own]
            back = (slope @ soft.T) / size[:, None]
            for k in range(WIDTH):
                moved[:, k] += np.bincount(at, np.repeat(back[:, k], size), len(used))
            turned += mean.T @ slope
            shifted += slope.sum(0)
        embed -= held_back * moved
        soft -= 0.1 * turned / total.sum()
        bias -= shifted / total.sum()
    table = np.zeros(BUCKETS)
    table[used] = embed @ (soft[:, 1] - soft[:, 0])
    return table, float(bias[1] - bias[0])


def _learn(docs: list[np.ndarray], labels: np.ndarray, words: list[str], seed: int) -> Model:
    """Rounds of training on the given documents' words (indices into ``words``)."""
    counts = np.bincount(np.concatenate(docs), minlength=len(words))
    used = np.flatnonzero(counts)
    place = np.full(len(words), -1)
    place[used] = np.arange(len(used))
    local = [place[d] for d in docs]
    buckets, starts = bags([words[k] for k in used])
    good = [d for d, y in zip(local, labels) if not y]
    bad = [d for d, y in zip(local, labels) if y]
    negative = np.bincount(np.concatenate(good), minlength=len(used)).astype(float)
    positive = np.bincount(np.concatenate(bad), minlength=len(used)).astype(float)
    # In the first round the two labels weigh the same; later ones know which words stand out.
    if negative.any() and positive.any():
        positive *= negative.sum() / positive.sum()
    for _ in range(ROUNDS):
        table, bias = train_words(buckets, starts, positive, negative, seed)
        odds = averages(table, buckets, starts) + bias
        positive = np.zeros(len(used))
        for d in bad:
            if len(d):
                best = odds[d].max()
                positive[d[odds[d] >= best - 1]] += BOOST
    return Model(table, bias, (1.0, 0.0), 0.0)


def _tops(model: Model, docs: list[np.ndarray], words: list[str]) -> list[list[float]]:
    odds = model.words(words)
    return [sorted(odds[d].tolist(), reverse=True)[:TOP] for d in docs]


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Model:
    """Fit on labelled texts. Without both labels, or any word, every score is the share of label 1 (one half without rows).

    Where only the texts of one label have words, a word speaks for that label.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max() or not any(map(words_of, texts)):
        return Model(np.zeros(BUCKETS), 0.0, (0.0, 0.0), float(np.log((share + 1e-4) / (1 - share + 1e-4))))
    index: dict[str, int] = {}
    docs = [np.array(sorted({index.setdefault(w, len(index)) for w in words_of(t)}), np.int64) for t in texts]
    words = list(index)
    # The step from words to documents is fitted on halves that their model has not seen.
    half = np.arange(len(docs)) % 2
    x = np.zeros((len(docs), 2))
    for side in (0, 1):
        rest, own = np.flatnonzero(half != side), np.flatnonzero(half == side)
        if 0 < labels[rest].sum() < len(rest) and any(len(docs[k]) for k in rest):
            model = _learn([docs[k] for k in rest], labels[rest], words, seed)
            x[own] = features(_tops(model, [docs[k] for k in own], words))
    model = _learn(docs, labels, words, seed)
    w = np.zeros(3)
    design = np.c_[x, np.ones(len(x))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        ridge = np.diag([1e-2, 1e-2, 1e-6])
        hess = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        w = w - np.clip(np.linalg.solve(hess, design.T @ (p - labels) + ridge @ w), -2, 2)
    return Model(model.table, model.bias, (float(w[0]), float(w[1])), float(w[2]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded labelled sample outside the held-out fold."""
    sample = samples.labelled(labels, label, FOLDS, HELD_OUT, SAMPLE_ROWS)
    rows = samples.with_texts(docs, sample, SAMPLE_BYTES, doc_id, text).toPandas()
    return fit(rows["text"].tolist(), rows["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.table.astype(np.float32), model.bias, model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        known: dict[str, float] = {}
        for batch in batches:
            listed = [set(words_of(t)) for t in batch.column(1).to_pylist()]
            fresh = list(set().union(*listed).difference(known))
            if len(known) + len(fresh) > REMEMBERED:
                known, fresh = {}, list(set().union(*listed))
            known.update(zip(fresh, own.words(fresh).tolist()))
            tops = [sorted(map(known.__getitem__, words), reverse=True)[:TOP] for words in listed]
            score = own.document(features(tops)) if tops else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return held.mapInArrow(run, f"doc_id {dict(held.dtypes)['doc_id']}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null, empty or wordless text gets the score of a document without a standing-out word. A null id
    is in fold 0; repeated rows get the same score each; other columns are ignored; an
    empty table gives an empty result.
    """
    model = train(docs, labels, doc_id=doc_id, text=text)
    return scored(docs, model, doc_id, text).select(
        "doc_id", (samples.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
