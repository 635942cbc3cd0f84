"""SentencePiece (BPE, byte fallback) encoding by suffix-array matching, and decoding.

No piece has a word mark behind another letter, and none holds a line break, so a text falls apart
into units that are encoded on their own; each distinct unit of a batch is encoded once. The units lie
end to end in one indexed text: its suffixes are sorted as far as the longest piece reaches, and a
binary search of every piece gives the range of its occurrences. These occurrences are edges. They are sorted by
position in their unit and relaxed from left to right, all units at once: a piece is taken behind the last
piece of a prefix if merging would have left the two side by side. Of every prefix exactly one
last piece passes, so the path found is the one that merging by score gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
NEVER = np.iinfo(np.int64).max
#: Letters of units indexed at once, and units remembered by a task.
INDEXED, REMEMBERED = 400_000, 400_000
CACHE_BITS = 21
#: Bytes of texts encoded at once, or one text: their units take many times that.
TOGETHER = 1 << 20


class Vocabulary:
    """Pieces, merge order and neighbour rules of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size, self.unknown = size, size
        listed = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        plain = [i for i in range(size) if not special[i]]
        self.bytes = np.zeros(256, np.int64)
        self.raw = [b""] * (size + 1)
        for i, piece in enumerate(listed):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not special[i]:
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.raw_length = np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        ids = {listed[i]: i for i in plain}
        self.blanks = {len(p): i for p, i in ids.items() if len(p) > 1 and not p.strip(MARK)}
        self.blank = ids.get(MARK)
        # Pieces of several marks merge after all others, left to right; ``encode`` adds them at the end.
        words = [i for i in plain if len(listed[i]) == 1 or listed[i].strip(MARK)]
        order = sorted(words, key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        for i in words:
            piece = listed[i]
            for k in range(1, len(piece)):
                x, y = ids.get(piece[:k]), ids.get(piece[k:])
                if x is not None and y is not None:
                    pairs[x, y] = i
        self._spines(words, listed, ids, rank, pairs)
        reached = [i for i in words if i in self.trees]
        self.pieces = np.array([listed[i] for i in reached])
        self.piece_ids = np.array(reached, np.int64)
        self.lengths = np.array([len(listed[i]) for i in reached], np.int64)
        self.longest = int(self.lengths.max())
        top = chr(0x10FFFF)
        self.upper = np.array([listed[i] + top * (self.longest - len(listed[i])) for i in reached])
        codes = np.array([x * (size + 1) + y for x, y in pairs], np.int64)
        sort = np.argsort(codes)
        self.pair_codes = codes[sort]
        self.pair_rank = np.array([rank[i] for i in pairs.values()], np.int64)[sort]
        self.cache_key = np.full(1 << CACHE_BITS, -1, np.int64)
        self.cache_ok = np.zeros(1 << CACHE_BITS, bool)

    def _spines(self, words, listed, ids, rank, pairs) -> None:
        """For each piece that merging its letters gives: the symbols at its two edges, when each comes and when it goes."""
        self.trees = {}
        for i in words:
            symbols = [(ids.get(c, -1), -1, None, None) for c in listed[i]]  # id, time it comes, left and right part
            now = -1
            while len(symbols) > 1:
                ranked = [(rank[pairs[a[0], b[0]]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (a[0], b[0]) in pairs]
                if not ranked:
                    break
                r, k = min(ranked)
                now = max(now, r)
                a, b = symbols[k], symbols[k + 1]
                symbols[k:k + 2] = [(pairs[a[0], b[0]], now, a, b)]
            if len(symbols) == 1 and symbols[0][0] == i:
                self.trees[i] = symbols[0]

        def edge(tree, side):
            out, goes = [], NEVER
            while tree is not None:
                out.append((tree[0], tree[1], goes))
                goes, tree = tree[1], tree[side]
            return out

        depth = max(max(len(edge(t, 2)), len(edge(t, 3))) for t in self.trees.values())
        self.left = np.full((3, depth, self.size + 1), -1, np.int64)
        self.right = np.full((3, depth, self.size + 1), -1, np.int64)
        for i, tree in self.trees.items():
            for table, side in ((self.left, 2), (self.right, 3)):
                for k, values in enumerate(edge(tree, side)):
                    table[:, k, i] = values
        self.left_depth = (self.left[0] >= 0).sum(0)
        self.right_depth = (self.right[0] >= 0).sum(0)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between pieces ``a`` and ``b``, pair by pair."""
        apart = np.ones(len(a), bool)
        for i in range(int(self.right_depth[a].max(initial=0))):
            for j in range(int(self.left_depth[b].max(initial=0))):
                x, y = self.right[0, i, a], self.left[0, j, b]
                live = np.flatnonzero((x >= 0) & (y >= 0) & apart)
                if not len(live):
                    continue
                code = x[live] * (self.size + 1) + y[live]
                at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
                live, at = live[self.pair_codes[at] == code], at[self.pair_codes[at] == code]
                r, p, q = self.pair_rank[at], a[live], b[live]
                when = np.maximum(r, np.maximum(self.right[1, i, p], self.left[1, j, q]))
                # At equal rank the merge further left comes first: that inside a, or else the one across.
                crosses = (when < self.right[2, i, p]) & (when <= self.left[2, j, q])
                crosses &= ~((when == self.left[2, j, q]) & (when > r))
                apart[live[crosses]] = False
        return apart

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stay_apart`` with the pairs met lately remembered."""
        code = a * (self.size + 1) + b
        slot = code * 2654435761 % (1 << CACHE_BITS)
        missing = self.cache_key[slot] != code
        out = self.cache_ok[slot]
        if missing.any():
            new, back = np.unique(code[missing], return_inverse=True)
            ok = self._stay_apart(new // (self.size + 1), new % (self.size + 1))
            out[missing] = ok[back]
            self.cache_key[slot[missing]] = code[missing]
            self.cache_ok[slot[missing]] = ok[back]
        return out

    def suffix_array(self, codes: np.ndarray) -> np.ndarray:
        """Positions in the order of their first ``longest`` letters, by doubling."""
        rank, reach = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
        order = None
        while reach < self.longest:
            ahead = np.zeros(len(rank), np.int64)
            ahead[:-reach] = rank[reach:] + 1
            key = rank * (len(codes) + 2) + ahead
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
            reach *= 2
        return np.argsort(rank, kind="stable") if order is None else order

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each unit); a unit is not empty and has at most one mark, in front."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer(("\0".join(units) + "\0" * (self.longest + 1)).encode("utf-32-le", "surrogatepass"), "<u4")
        n = int(lengths.sum()) + len(units)
        first = np.cumsum(lengths + 1) - lengths - 1
        offset = np.arange(n) - np.repeat(first, lengths + 1)
        order = self.suffix_array(codes[:n])
        windows = np.lib.stride_tricks.sliding_window_view(codes, self.longest)[order]
        windows = np.ascontiguousarray(windows).view(f"<U{self.longest}").ravel()
        lo = np.searchsorted(windows, self.pieces, "left")
        many = np.searchsorted(windows, self.upper, "right") - lo
        many = np.maximum(many, 0)
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        start, piece = order[at], np.repeat(self.piece_ids, many)
        stop = start + np.repeat(self.lengths, many)
        # Letters without a piece are edges of their own; they merge with nothing.
        odd = np.ones(n, bool)
        odd[start[stop == start + 1]] = False
        odd[first + lengths] = False
        odd = np.flatnonzero(odd)
        start, stop = np.r_[start, odd], np.r_[stop, odd + 1]
        piece = np.r_[piece, np.full(len(odd), self.unknown)]
        sort = np.argsort(offset[start], kind="stable")
        start, stop, piece = start[sort], stop[sort], piece[sort]
        steps = np.searchsorted(offset[start], np.arange(int(lengths.max(initial=0)) + 1))
        last, origin = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        for o in range(int(lengths.max(initial=0))):
            s, e, p = (x[steps[o]:steps[o + 1]] for x in (start, stop, piece))
            if o:
                ok = last[s] >= 0
                s, e, p = s[ok], e[ok], p[ok]
                ok = self.apart(last[s], p)
                s, e, p = s[ok], e[ok], p[ok]
            last[e], origin[e] = p, s
        # Back from the ends, all units at once.
        at, unit = first + lengths, np.arange(len(units))
        found = []
        while len(at):
            found.append((unit, last[at], origin[at]))
            at = origin[at]
            live = at > first[unit]
            at, unit = at[live], unit[live]
        count = np.bincount(np.concatenate([f[0] for f in found]), minlength=len(units)) if found else np.zeros(0, np.int64)
        head = np.cumsum(count) - count
        ids, places = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        for k, (unit, values, origins) in enumerate(found):
            slot = head[unit] + count[unit] - 1 - k
            ids[slot], places[slot] = values, origins
        unknown = np.flatnonzero(ids == self.unknown)
        if not len(unknown):
            return ids, count
        spelled = [chr(c).encode("utf-8", "replace") for c in codes[places[unknown]]]
        sizes = np.ones(len(ids), np.int64)
        sizes[unknown] = [len(b) for b in spelled]
        wide = np.repeat(ids, sizes)
        wide[wide == self.unknown] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return wide, np.add.reduceat(sizes, head)


class Encoder:
    """Encoding and decoding of batches of texts, with the units seen so far remembered."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.count = (np.zeros(0, np.int64) for _ in range(3))

    def _blanks(self, n: int) -> list[int]:
        """The pieces of a run of word marks. All such pieces have one score, so the merge furthest left comes first."""
        v = self.vocabulary
        most = max(v.blanks, default=1)
        # A run of the longest piece merges no further, so whole ones are set off first.
        sizes = [1] * (n % most if most > 1 else n)
        while (k := next((k for k, (a, b) in enumerate(zip(sizes, sizes[1:])) if a + b in v.blanks), None)) is not None:
            sizes[k:k + 2] = [sizes[k] + sizes[k + 1]]
        return [v.blanks[most]] * (n // most) * (most > 1) + [v.blanks.get(s, v.blank) for s in sizes]

    def _learn(self, units: list[str]) -> None:
        cores = [MARK + u.lstrip(MARK) if u[0] == MARK else u for u in units]
        ids, count = self.vocabulary.encode_units(cores)
        runs = [k for k, u in enumerate(units) if u.startswith(MARK + MARK)]
        if runs:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in runs:
                more = len(units[k]) - len(cores[k])
                own = parts[k].tolist()
                lone = own[0] == self.vocabulary.blank
                parts[k] = np.array(self._blanks(more + lone) + own[lone:], np.int64)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        base, begin = len(self.count), len(self.ids)
        self.known.update(zip(units, range(base, base + len(units))))
        self.start = np.r_[self.start, begin + np.cumsum(count) - count]
        self.ids, self.count = np.r_[self.ids, ids], np.r_[self.count, count]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each)."""
        listed = [UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = {u for units in listed for u in units}.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = {u for units in listed for u in units}
        held, size = [], 0
        for unit in sorted(fresh, key=len):
            held.append(unit)
            size += len(unit) + 1
            if size >= INDEXED:
                self._learn(held)
                held, size = [], 0
        if held:
            self._learn(held)
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        index = np.fromiter((self.known[u] for units in listed for u in units), np.int64, int(sizes.sum()))
        count = self.count[index]
        ids = self.ids[np.repeat(self.start[index] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        total = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(sizes)]]
        return ids, np.diff(total)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids that lie end to end; bytes that are no UTF-8 become replacement characters."""
        v = self.vocabulary
        length = v.raw_length[ids]
        flat = v.raw_flat[np.repeat(v.raw_start[ids] - np.cumsum(length) + length, length) + np.arange(length.sum())].tobytes()
        ends = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(counts)]].tolist()
        texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have ``TOGETHER`` bytes and at most one text more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // TOGETHER
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
    for begin, end in zip(cuts, cuts[1:]):
        yield batch.slice(begin, end - begin)


def encode_documents(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", n: str = "n_tokens",
                     exact: str = "round_trip") -> DataFrame:
    """``docs`` with the ids of each text, their number, and whether decoding them gives the text back.

    ``model`` is the path of the model file on the executors. Null and empty texts have no ids and come back as
    empty. Columns of the three names are replaced; all others and repeated rows stay; an empty table stays empty.
    A text that itself holds the word mark comes back with a space in its place.
    """
    own = [c for c in docs.columns if c not in (ids, n, exact)]
    held = docs.select(*own)
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in (part for whole in batches for part in slices(whole, at)):
            encoder = encoder or Encoder(model)
            texts = batch.column(at).to_pylist()
            flat, counts = encoder.encode(texts)
            same = [a == (b or "") for a, b in zip(encoder.decode(flat, counts), texts)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, pa.array(counts, pa.int32()), pa.array(same, pa.bool_())],
                names=[*batch.schema.names, ids, n, exact])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return held.mapInArrow(run, f"{fields}, `{ids}` array<int>, `{n}` int, `{exact}` boolean")


def decode_documents(docs: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the texts of a column of ids; null ids give a null text."""
    own = [c for c in docs.columns if c != text]
    held = docs.select(*own)
    at = own.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(model)
            lists = batch.column(at).to_pylist()
            counts = np.array([len(x or ()) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            texts = [None if x is None else t for x, t in zip(lists, encoder.decode(flat, counts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return held.mapInArrow(run, f"{fields}, `{text}` string")
