"""Benchmark decontamination: where texts hold benchmark items, whole or in part, up to an edit budget.

Both sides are reduced to lower-case letters and digits with single spaces. A text within k edits of
an item of length m shares at least m - q + 1 - k q of its character q-grams with it (the
q-gram lemma), and it shares them on diagonals (text position less item position) that lie within k of each other. Shared
q-grams are counted in diagonal bands of twice that width that overlap by half, so some band
holds them all; regions that reach the bound are verified by banded alignment. q is 8, or less where that bound would fall under 1.

An item counts as found wherever all of it aligns within the budget. Of an item longer than a window, overlapping windows are looked for in
the same way, so a copied part is found too. An item too short for any edit is looked up as it is, between word borders.

The benchmark is a stated query set. It is cut into blocks of bounded size, each broadcast in turn, so it may be of any size; the
corpus is only read. Only letters that the q-grams of a block select are looked at twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from qaloom.session import cut

#: q-gram length, edits per item character, characters of benchmark text in a block.
Q, BUDGET, BLOCK_CHARS = 8, 0.1, 1_000_000
#: Shorter items are looked up as they are; items of fewer than the second number of characters are no evidence and passed over.
ALIGNED, SHORTEST = 24, 5
#: Characters of a window of a longer item, and from one window to the next: a copied part of both together always holds a window.
WINDOW, STRIDE = 64, 32
#: q-grams of a text that are looked up at once, counted with their places in items.
SLICE = 1 << 17
#: Letters of text handled at once; a longer text is cut into overlapping pieces.
PIECE = 1 << 20
JUNK = re.compile(r"[\W_]+")
#: Letters of scripts that put no blanks between words: a word may begin or end beside each.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
PRIME = np.uint64(1099511628211)


def normal(text: str | None) -> str:
    """Letters and digits in lower case, with single spaces."""
    return JUNK.sub(" ", (text or "").lower()).strip()


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 14695981039346656037, np.uint64)
    wide = codes.astype(np.uint64)
    for k in range(q):
        out = (out ^ wide[k:k + n]) * PRIME
    return out ^ (out >> np.uint64(31))


def budget_of(length: int) -> int:
    return int(BUDGET * length)


def gram_length(length: int) -> int:
    """The longest q of at most ``Q`` for which an item within its budget shares a q-gram: q (k + 1) <= m."""
    return min(Q, length // (budget_of(length) + 1))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of a whole item in a text, on diagonals low to high; None over ``most``.

    Rows of the alignment run over the item, columns over the diagonals. Starting and ending anywhere in
    the text is free.
    """
    far = most + 1
    width = high - low + 1
    diagonals = np.arange(low, high + 1)
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    start = diagonals.copy()
    steps = np.arange(width)
    skipped, moved = np.full(width, far), np.zeros(width, np.int64)
    for i in range(len(item)):
        at = diagonals + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == item[i]
        taken = np.where(inside, cost + ~same, far)
        skipped[:-1] = cost[1:] + 1
        moved[:-1] = start[1:]
        by_skip = skipped < taken
        new = np.where(by_skip, skipped, taken)
        begin = np.where(by_skip, moved, start)
        # Letters put in between: the least over all earlier diagonals of cost plus distance.
        slope = new - steps
        least = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == least, steps, 0))
        cost = np.minimum(least + steps, far)
        start = begin[source]
        if cost.min() > most:
            return None
    ends = diagonals + len(item)
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, far)
    best = int(cost.argmin())
    return None if cost[best] > most else (int(cost[best]), int(start[best]), int(ends[best]))


def apart(hits: list[tuple]) -> list[tuple]:
    """(edits, start, end, …) that do not overlap, the best first, in order of their start."""
    kept: list[tuple] = []
    for hit in sorted(set(hits)):
        if all(hit[2] <= other[1] or other[2] <= hit[1] for other in kept):
            kept.append(hit)
    return sorted(kept, key=lambda h: h[1])


def windows(length: int) -> list[int]:
    """Where the windows of an item begin; none if it is no longer than one."""
    return [] if length <= WINDOW else [*range(0, length - WINDOW, STRIDE), length - WINDOW]


class Probes:
    """Items and windows of one q-gram length, and the places of their q-grams, for looking up those of a text."""

    def __init__(self, q: int, texts: list[str]):
        self.q, self.texts = q, texts
        self.codes = [letters(t) for t in texts]
        hashes = [gram_hashes(c, q) for c in self.codes]
        owner = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.counts = np.unique(flat, return_counts=True)
        self.begins = np.cumsum(self.counts) - self.counts
        bits = max(16, int(len(flat) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(flat >> self.shift).astype(np.int64)] = True
        sizes = np.array([len(c) for c in self.codes])
        self.longest = int(sizes.max())
        self.most = (BUDGET * sizes).astype(np.int64)
        self.bound = sizes - q + 1 - self.most * q

    def _hits(self, hashes: np.ndarray) -> list:
        """Ways to get (probe, diagonal, place in the probe) of every q-gram of the text that is one of a probe, in slices of bounded size."""
        maybe = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        wanted = hashes[maybe]
        known = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        same = self.hashes[known] == wanted
        maybe, known = maybe[same], known[same]
        low, many = self.begins[known], self.counts[known]
        upto = np.cumsum(many)

        def slice_of(first: int, end: int):
            own, n = maybe[first:end], many[first:end]
            at = np.repeat(low[first:end] - (upto[first:end] - n - (upto[first] - many[first])), n) + np.arange(n.sum())
            place = self.place[at]
            return self.owner[at], np.repeat(own, n) - place, place

        if not len(maybe):
            return []
        if upto[-1] <= SLICE:
            only = slice_of(0, len(maybe))
            return [lambda: only]
        cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(SLICE, upto[-1], SLICE)), len(maybe)])
        return [lambda first=first, end=end: slice_of(first, end) for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def regions(self, hashes: np.ndarray, length: int) -> list[tuple[int, int, int]]:
        """(probe, lowest, highest diagonal) of the bands that reach the bound."""
        hits = self._hits(hashes)
        total = np.zeros(len(self.texts), np.int64)
        for get in hits:
            total += np.bincount(get()[0], minlength=len(total))
        # A probe with fewer hits in the whole text than its bound has no band that reaches it.
        enough = total >= self.bound
        if not enough.any():
            return []
        base = self.longest + 1
        wide = length + 4 * base
        found = []
        for half in (0, 1):
            once = np.zeros(0, np.int64)
            for get in hits:
                item, diagonal, place = get()
                live = enough[item]
                item, diagonal, place = item[live], diagonal[live], place[live]
                # Twice the budget: the edits of the match, and as many by which q-grams may stray from its diagonal.
                step = 2 * self.most[item] + 1
                band = (diagonal + base + half * step // 2 + step) // step
                # Each q-gram of a probe counts once in a band, however often the text repeats it.
                own = np.sort((item * np.int64(wide) + band) * base + place)
                once = np.union1d(once, own) if len(once) else own[np.r_[True, own[1:] != own[:-1]]]
            once //= base
            starts = np.flatnonzero(np.r_[True, once[1:] != once[:-1]])
            key, count = once[starts], np.diff(np.r_[starts, len(once)])
            owner = key // wide
            for k in np.flatnonzero(count >= self.bound[owner]):
                i = int(owner[k])
                step = int(2 * self.most[i] + 1)
                low = int(key[k] % wide) * step - step - half * step // 2 - base
                found.append((i, low - step // 2, low + step + step // 2))
        return found

    def search(self, text: str, codes: np.ndarray) -> dict[int, list[tuple]]:
        """By probe: (edits, start, end) of its verified places in a text."""
        found: dict[int, list[tuple]] = {}
        reach = 2 * self.longest + 2
        for begin in range(0, max(1, len(codes)), PIECE):
            piece = codes[begin:begin + PIECE + reach]
            copies: dict[int, list[int]] = {}
            for i, low, high in self.regions(gram_hashes(piece, self.q), len(piece)):
                if i not in copies:
                    # Copies without edits need no alignment.
                    copies[i] = [m.start() for m in re.finditer(f"(?={re.escape(self.texts[i])})", text[begin:begin + len(piece)])]
                    size = len(self.texts[i])
                    found.setdefault(i, []).extend((0, begin + at, begin + at + size) for at in copies[i])
                if any(low <= at <= high for at in copies[i]):
                    continue
                hit = banded_distance(self.codes[i], piece, low, high, int(self.most[i]))
                if hit:
                    found.setdefault(i, []).append((hit[0], begin + hit[1], begin + hit[2]))
        return found


class Block:
    """Some items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple]):
        self.items = items
        by_length: dict[int, list[tuple[int, int, str]]] = {}
        self.short = ahocorasick.Automaton()
        for k, (_, text) in enumerate(items):
            if len(text) < ALIGNED:
                self.short.add_word(text, [*self.short.get(text, []), k])
                continue
            by_length.setdefault(gram_length(len(text)), []).append((k, -1, text))
            for begin in windows(len(text)):
                by_length.setdefault(gram_length(WINDOW), []).append((k, begin, text[begin:begin + WINDOW]))
        self.groups = [(owners, Probes(q, [t for _, _, t in owners])) for q, owners in by_length.items()]
        if len(self.short):
            self.short.make_automaton()

    def _copies(self, text: str) -> Iterator[tuple]:
        """Short items between word borders."""
        for last, owners in self.short.iter(text) if len(self.short) else ():
            end = last + 1
            begin = end - len(self.items[owners[0]][1])
            left = begin == 0 or text[begin - 1] == " " or UNSPACED.match(text[begin - 1]) or UNSPACED.match(text[begin])
            right = end == len(text) or text[end] == " " or UNSPACED.match(text[end]) or UNSPACED.match(text[last])
            if left and right:
                yield from ((k, 0, begin, end) for k in owners)

    def search(self, text: str) -> list[tuple]:
        """(item id, edits, start, end, share) of the separate places of each item in a normalised text.

        ``share`` is 1 for a whole item. Of a part it is the share of the item's characters in the windows found side by side, and its edits
        are the most in one of them; parts that overlap a whole copy are not told again.
        """
        codes = letters(text)
        whole: dict[int, list[tuple]] = {}
        parts: dict[int, list[tuple]] = {}
        for owners, probes in self.groups:
            for i, hits in probes.search(text, codes).items():
                item, begin, _ = owners[i]
                if begin < 0:
                    whole.setdefault(item, []).extend(hits)
                else:
                    parts.setdefault(item, []).extend((start, end, edits, begin) for edits, start, end in apart(hits))
        for item, *hit in self._copies(text):
            whole.setdefault(item, []).append(tuple(hit))
        out = []
        for item in sorted(whole.keys() | parts.keys()):
            name, own = self.items[item]
            copies = apart(whole.get(item, []))
            out += [(name, edits, start, end, 1.0) for edits, start, end in copies]
            runs: list[list] = []
            for start, end, edits, begin in sorted(parts.get(item, [])):
                if any(start < e and s < end for _, s, e in copies):
                    continue
                if runs and start <= runs[-1][1] and begin > runs[-1][3][-1]:
                    runs[-1][1], runs[-1][2] = max(runs[-1][1], end), max(runs[-1][2], edits)
                    runs[-1][3].append(begin)
                else:
                    runs.append([start, end, edits, [begin]])
            for start, end, edits, begins in runs:
                covered = np.zeros(len(own), bool)
                for begin in begins:
                    covered[begin:begin + WINDOW] = True
                out.append((name, edits, start, end, float(covered.mean())))
        return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple]]:
    """The normalised items in blocks of at most ``BLOCK_CHARS`` characters (or one item), read partition by partition."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").orderBy("i", "t")
    for row in rows.toLocalIterator():
        clean = normal(row["t"])
        if len(clean) < SHORTEST:
            continue
        if held and size + len(clean) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row["i"], clean))
        size += len(clean)
    if held:
        yield held


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, edits, region, share): each separate place of each item in each text, with its words.

    ``share`` is that of the item that stands there. Null and empty texts hold nothing. A repeated row gives its rows again, a repeated
    item too; other columns are ignored. An empty benchmark or table gives an empty result.
    """
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    kind, item_kind = dict(held.dtypes)["doc_id"], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, region string, share double"
    types = [to_arrow_type(held.schema["doc_id"].dataType), to_arrow_type(benchmark.schema[item_id].dataType), pa.int32(), pa.string(), pa.float64()]
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for items in blocks(benchmark, item_id):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Block(shared.value)
            for batch in batches:
                rows = []
                for key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    clean = normal(raw)
                    rows += [(key, i, edits, clean[a:b], share) for i, edits, a, b, share in block.search(clean)]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(values), kind) for values, kind in zip(columns, types)],
                    names=["doc_id", "item_id", "edits", "region", "share"])

        out = out.unionByName(held.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, whole or in part, with their columns.

    Rows are judged where they are read, so nothing is joined or shuffled; ids do not matter. A benchmark of several blocks is gone
    through block by block, with the rows that are left written in between.
    """
    spark = docs.sparkSession
    names, at = docs.columns, docs.columns.index(text)
    # Names with dots cannot be passed to mapInArrow.
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    schema = docs.schema
    for number, items in enumerate(blocks(benchmark)):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Block(shared.value)
            for batch in batches:
                clean = [not block.search(normal(raw.as_py())) for raw in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))
            # The worker goes on to other stages; what whole rows took is given back.
            pa.default_memory_pool().release_unused()

        docs = (cut(docs) if number else docs).mapInArrow(run, schema)
    return docs.toDF(*names)
