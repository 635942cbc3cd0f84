"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on a bounded labelled sample. Each path from a root is a rule, a conjunction of
bounds on statistics; a logistic model with an L1 penalty gives most rules weight zero. What remains
is compiled to a column expression, so scoring is one pass of built-in functions over the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm import samples
from qaloom.operators.skew import fixed

FOLDS, HELD_OUT = 5, 0
#: Labelled rows that the ensemble is fitted on, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, CUTS, LEAST_LEAF = 24, 3, 24, 5
PENALTY, STEPS = 0.002, 400
THRESHOLD = 0.3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"

#: A rule: bounds (statistic, is_upper_bound, value) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def _removed(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null text has those of an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(words), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    follow = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.when(a == b, 1))
    return {
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(F.array_join(words, "")) / n,
        "symbols": _removed(text, SYMBOLS) / chars,
        "capitals": _removed(text, CAPITALS) / chars,
        "digits": _removed(text, "0123456789") / chars,
        "marks": _removed(text, ".,;:!?") / chars,
        "calls": _removed(text, "!?") / chars,
        # A share of distinct words would fall with the length of any prose; the ratio of logarithms hardly does.
        "distinct": F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n.cast("double")),
        "repeats": F.size(F.array_compact(follow)) / n,
        "line_copies": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": F.log1p(F.size(words) / F.greatest(F.size(lines), F.lit(1))),
    }


def grow(x: np.ndarray, target: np.ndarray, rows: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> list[Rule]:
    """The paths, inner ones too, of a regression tree on some rows and half of the statistics."""
    columns = np.sort(rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2 + 1])
    rules: list[Rule] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 2 * LEAST_LEAF:
            return
        best = (1e-9, None)
        y = target[rows]
        for j in columns:
            values = x[rows, j]
            marks = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)))
            cuts = (marks[1:] + marks[:-1]) / 2
            if not len(cuts):
                continue
            below = values[:, None] <= cuts[None, :]
            count = below.sum(0)
            left = (y[:, None] * below).sum(0)
            ok = (count >= LEAST_LEAF) & (len(rows) - count >= LEAST_LEAF)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left**2 / count + (y.sum() - left) ** 2 / (len(rows) - count) - y.sum() ** 2 / len(rows)
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (int(j), float(cuts[k])))
        if best[1] is None:
            return
        j, cut = best[1]
        low = x[rows, j] <= cut
        split(rows[low], (*path, (j, True, cut)))
        split(rows[~low], (*path, (j, False, cut)))

    split(rows, ())
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, upper, cut in rule:
        out &= (x[:, j] <= cut) == upper
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic model, by accelerated proximal steps."""
    n, m = r.shape
    design = np.c_[r.astype(np.float64), np.ones(n)]
    v = np.ones(m + 1)
    for _ in range(20):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    size = 4 * n / max(float(v @ (design.T @ (design @ v))), 1e-9)
    w, ahead, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -35, 35)))
        stepped = ahead - size * (design.T @ (p - y)) / n
        new = np.sign(stepped) * np.maximum(np.abs(stepped) - size * penalty, 0)
        new[-1] = stepped[-1]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules over named statistics."""

    names: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 from columns with the statistics' names."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            met = F.lit(True)
            for j, upper, cut in rule:
                name = F.col(self.names[j])
                met = met & (name <= cut if upper else name > cut)
            total = total + F.when(met, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    """Fit on rows of statistics; without rows or with one label only the intercept is left."""
    if not len(y) or y.min() == y.max():
        return Ensemble(tuple(names), (), (), 0.0 if not len(y) else (6.0 if y[0] else -6.0))
    rng = np.random.default_rng(seed)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(2, len(y) // 2)])
        grown = grow(x, residual, rows, rng)
        rules.update(dict.fromkeys(grown))
        for rule in grown:
            if len(rule) == DEPTH:
                inside = holds(rule, x)
                margin[inside] += np.clip(4 * residual[inside].mean(), -1, 1) if inside.any() else 0
    listed = list(rules)
    weights, intercept = lasso(np.stack([holds(rule, x) for rule in listed], 1), y) if listed else (np.zeros(0), 0.0)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble(tuple(names), tuple(listed[k] for k in kept), tuple(float(weights[k]) for k in kept), intercept)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on the documents of a bounded labelled sample outside the held-out fold."""
    sample = samples.labelled(labels, label, FOLDS, HELD_OUT, rows)
    stats = statistics(F.col("text"))
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # ``sample`` has at most ``rows`` rows, and so has what reaches the driver.
    found = held.join(F.broadcast(sample), "doc_id").select("doc_id", "label", *[c.alias(n) for n, c in stats.items()])
    table = found.orderBy("doc_id", *stats).limit(rows).toPandas()
    return fit(list(stats), table[list(stats)].to_numpy(np.float64), table["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    stats = {f"__{name}": c for name, c in statistics(F.col(text)).items()}
    named = Ensemble(tuple(f"__{n}" for n in model.names), model.rules, model.weights, model.intercept)
    wide = fixed(docs.select(*own, *[c.alias(n) for n, c in stats.items()]), *stats)
    out = fixed(wide.select(*own, named.score().alias("score")), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of a text without words. A null id is held out; repeated
    rows get the same score each; other columns are ignored. Without labels every score is one half.
    """
    model = train(docs, labels, doc_id=doc_id, text=text)
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return scored(held, model).select(
        "doc_id", (samples.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted"
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    marked = docs.withColumn("__text", F.col(text))
    keyed = scored(marked.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), "__text"), model, "__text")
    return keyed.where("predicted = 1").select("__row.*")
