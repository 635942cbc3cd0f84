"""Document fingerprints by MinHash, their likeness, and near-duplicate classes.

A text's shingles of five words are hashed to 32 bits; 128 universal hash permutations (a x + b modulo 2 ** 64, of which the upper
half counts) give the least value of each, and 16 bits of that are kept. The share of equal values of two fingerprints estimates the
Jaccard similarity of the shingle sets.

Near-duplicates: signatures are cut into 32 bands of four values. Texts that share a band meet in a bucket, a Spark join. A
bucket is never expanded into its pairs: its members are compared with a few pivots, verified links are joined into classes, and the next
round has only the pairs that lie in different classes still, with twice the pivots. It ends when every pair that shares
a band is linked, in one class, or verified as unlike. Two texts at similarity 0.8 share no band with a probability of 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from qaloom.llm.components import components
from qaloom.operators.skew import join_unique
from qaloom.session import cut

SHINGLE, SIMILAR = 5, 0.8
#: Permutations, bands, and bytes of one value of a signature.
HASHES, BANDS, WIDTH = 128, 32, 2
ROWS = HASHES // BANDS
#: Shingles that are permuted at once, and words whose hash a task remembers; past that it starts anew.
BLOCK, REMEMBERED = 2048, 500_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_rng = np.random.default_rng(13)
FACTORS = _rng.integers(0, 1 << 64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, HASHES, np.uint64, endpoint=False)
#: Of a text without a word; no other signature is like it.
EMPTY = np.full(HASHES, (1 << 64) - 1, np.uint64)


class _Words(dict):
    """The hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Shingle hashes of texts; words are remembered in between."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.known = shingle, _Words()

    def words(self, text: str) -> np.ndarray:
        """The hash of each word: runs without ASCII blanks, A-Z lower-cased."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """A 32-bit hash of each shingle, repeats included; of a shorter text the one of all its words."""
        if not len(words):
            return np.zeros(0, np.uint64)
        size = min(self.shingle, len(words))
        n = len(words) - size + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(size):
            mixed = (mixed ^ words[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed >> np.uint64(32)


def least(segments: list[np.ndarray]) -> np.ndarray:
    """The least value of every permutation over each segment of shingles, one row a segment; ``EMPTY`` over none."""
    out = np.tile(EMPTY, (len(segments), 1))
    flat = np.concatenate(segments) if segments else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
    for at in range(0, len(flat), BLOCK):
        own = owner[at:at + BLOCK]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        values = FACTORS[:, None] * flat[None, at:at + BLOCK]
        values += OFFSETS[:, None]
        there = own[starts]
        out[there] = np.minimum(out[there], np.minimum.reduceat(values, starts, axis=1).T)
    return out


def kept(values: np.ndarray) -> np.ndarray:
    """The 16 bits kept of each least value."""
    return (values >> np.uint64(32)).astype(np.uint16)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The share of equal values of signatures, row by row."""
    return (one == other).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of another one."""
    most = len(text) // 4
    return text[:len(text) - most] + following[:most]


def _pairs(shingler: Shingler, texts: list[str], following: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(signatures of texts, signatures of the edited texts, digests of the edited texts)."""
    segments, digests = [], []
    for text, after in zip(texts, following):
        new = edited(text, after)
        digests.append(sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
        own, other = (shingler.shingles(shingler.words(t)) for t in (text, new))
        # Both begin alike; what they share is permuted once.
        n = min(len(own), len(other))
        differs = np.flatnonzero(own[:n] != other[:n])
        same = int(differs[0]) if len(differs) else n
        segments += [own[:same], own[same:], other[same:]]
    found = least(segments).reshape(-1, 3, HASHES)
    return kept(np.minimum(found[:, 0], found[:, 1])), kept(np.minimum(found[:, 0], found[:, 2])), digests


def packed(signatures: np.ndarray) -> pa.Array:
    """The signatures in bytes, as they are kept in intermediate tables."""
    return pa.array([row.astype(">u2").tobytes() for row in signatures], pa.binary())


FOUND = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _columns(texts: list[str], own: np.ndarray, new: np.ndarray, digests: list[str], after: np.ndarray) -> list[pa.Array]:
    """The columns of ``FOUND``."""
    return [
        pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()), packed(own), packed(new),
        pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, after), pa.float64())]


def _signed(shingler: Shingler, text: str) -> np.ndarray:
    return kept(least([shingler.shingles(shingler.words(text))]))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the next row by ascending id (null first), then by a hash of the text; after the last comes the
    first. A null text counts as empty; a text without a word has the signature of no shingles, which is like itself alone. Repeated rows are documents of
    their own; other columns are ignored. An empty table gives an empty result; a single row is its own next one.

    Texts are cut into ranges of ids, so the next row stands in the same task; only the first and last rows of the ranges
    meet in a join afterwards.
    """
    held = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = held.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    keys = ["doc_id", "hash", "tie"]
    ranges = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("range"), "doc_id", "text")
    kind, arrow_kind = dict(held.dtypes)["doc_id"], to_arrow_type(held.schema["doc_id"].dataType)
    names = ["range", "edge", "doc_id", "text", *(part.split()[0] for part in FOUND.split(", "))]
    schema = f"range int, edge string, doc_id {kind}, text string, {FOUND}"

    def edge(where: int, name: str, key: pa.Scalar, text: str) -> pa.RecordBatch:
        empty = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays(
            [pa.array([where], pa.int32()), pa.array([name]), pa.array([key], arrow_kind), pa.array([text], pa.string()), *empty], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            where, ids, texts = (c.to_pylist() for c in batch.columns)
            if last is None:
                yield edge(where[0], "first", ids[0], texts[0])
            else:
                ids, texts = [last[1], *ids], [last[2], *texts]
            last = where[0], ids[-1], texts[-1]
            if len(texts) > 1:
                own, new, digests = _pairs(shingler, texts[:-1], texts[1:])
                after = np.concatenate([own[1:], _signed(shingler, texts[-1])])
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where[0]] * n, pa.int32()), pa.nulls(n, pa.string()), pa.array(ids[:-1], arrow_kind), pa.nulls(n, pa.string()),
                     *_columns(texts[:-1], own, new, digests, after)], names=names)
        if last:
            yield edge(last[0], "last", last[1], last[2])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts, following = (batch.column(k).to_pylist() for k in (1, 2))
            own, new, digests = _pairs(shingler, texts, following)
            after = np.concatenate([_signed(shingler, t) for t in following]) if texts else own
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(texts, own, new, digests, after)], names=["doc_id", *names[4:]])

    made = cut(ranges.mapInArrow(run, schema))
    firsts, lasts = (made.where(F.col("edge") == name).select("range", "doc_id", "text") for name in ("first", "last"))
    # One row a range: few rows, whose texts are not in the window.
    order = W.orderBy("range")
    least_range = F.min("range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    chain = firsts.select("range").withColumn("next", F.coalesce(F.lead("range").over(order), least_range))
    pairs = lasts.join(chain, "range").join(firsts.select(F.col("range").alias("next"), F.col("text").alias("following")), "next")
    edges = pairs.select("doc_id", "text", "following").mapInArrow(join, f"doc_id {kind}, {FOUND}")
    found = made.where("edge is null").drop("range", "edge", "text").unionByName(edges)
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, content, hash, signature): a digest of the words, a hash of the text, and the signature in bytes."""
    held = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    kind = dict(held.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            words = [shingler.words(t) for t in batch.column(1).to_pylist()]
            signatures = kept(least([shingler.shingles(w) for w in words]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary()), batch.column(2),
                 pa.array([s.tobytes() for s in signatures], pa.binary())], names=["doc_id", "content", "hash", "signature"])

    return held.mapInArrow(run, f"doc_id {kind}, content binary, hash bigint, signature binary")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, shingles): the shingle set of each node (node, content, hash), as sorted 32-bit numbers."""
    held = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    wanted = nodes.groupBy("hash").agg(F.collect_list(F.struct("node", "content")).alias("own"))
    texts = join_unique(held, wanted, ["hash"], "inner").dropDuplicates(["hash", "text"])
    texts = texts.select("text", F.explode("own").alias("own")).select("text", "own.node", "own.content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for raw, node, content in zip(*(c.to_pylist() for c in batch.columns)):
                words = shingler.words(raw)
                if xxhash.xxh3_128_digest(words.tobytes()) == content:
                    rows.append((node, np.unique(shingler.shingles(words)).astype("<u4").tobytes()))
            columns = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles binary")


def jaccard(one: bytes, other: bytes) -> float:
    """The similarity of two sets of distinct 32-bit numbers; of two empty ones 1."""
    a, b = np.frombuffer(one, "<u4"), np.frombuffer(other, "<u4")
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"), F.length("shingles").alias(f"n{name}"))

    both = join_unique(join_unique(pairs, side("a"), ["a"], "inner"), side("b"), ["b"], "inner")
    both = both.where(F.least("na", "nb") >= similar * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [jaccard(x, y) >= similar for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(alike, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node): nodes (node, signature) under each band that they share with another one."""
    size = ROWS * WIDTH
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("signature", k * size + 1, F.lit(size))))
    placed = nodes.select("node", F.explode(bands).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    return join_unique(placed, shared, ["bucket"], "inner").select("bucket", "node")


def links(members: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, root): the classes of all nodes that are linked to another one.

    In every round a bucket has 2 ** round pivots at most, none of them from the bucket's largest class, and none twice.
    """
    spark = members.sparkSession
    edges = spark.createDataFrame([], "a bigint, b bigint")
    labels, tested = None, edges
    pivoted = spark.createDataFrame([], "bucket bigint, node bigint")
    power = 0
    while True:
        if labels is None:
            named = members.withColumn("root", F.col("node"))
        else:
            named = join_unique(members, labels, ["node"]).withColumn("root", F.coalesce("root", "node"))
        classes = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = classes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("k"))
        named = cut(join_unique(named, mixed.where("k > 1").select("bucket", F.col("most.root").alias("largest")), ["bucket"], "inner"))
        open_ = named.where("root <> largest").select("bucket", "node").join(pivoted, ["bucket", "node"], "left_anti")
        pivots = cut(open_.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(1 << power)).alias("slot")).agg(F.min("node").alias("node")).drop("slot"))
        if pivots.isEmpty():
            break
        chosen = join_unique(pivots, named.select("bucket", "node", "root"), ["bucket", "node"], "inner")
        chosen = chosen.groupBy("bucket").agg(F.collect_list(F.struct("node", "root")).alias("pivots"))
        met = join_unique(named.select("bucket", "node", "root"), chosen, ["bucket"], "inner").select(
            "node", "root", F.explode("pivots").alias("p")).where("root <> p.root")
        pairs = met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        edges = cut(edges.unionByName(_verified(pairs, sets, similar)))
        labels = cut(components(edges))
        tested, pivoted, power = tested.unionByName(pairs), pivoted.unionByName(pivots), power + 1
    return components(edges) if labels is None else labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: (doc_id, component_id), the least id reachable over links at a similarity of 0.8 or more.

    Texts of the same words are of one class, wordless and null texts of one too. A repeated row gets its row again; a null id
    takes part and is a component id only where the class has no other. Other columns are ignored; an empty table gives an empty result.
    """
    marked = cut(_marked(docs, doc_id, text))
    nodes = marked.groupBy("content").agg(F.min("doc_id").alias("first"), F.min("hash").alias("hash"), F.min("signature").alias("signature"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = cut(buckets(nodes))
    held = join_unique(nodes, members.select("node").distinct(), ["node"], "inner").select("node", "content", "hash")
    sets = cut(_shingle_sets(docs, held, text))
    roots = links(members, sets)
    named = cut(join_unique(nodes.select("content", "first", "node"), roots, ["node"]).withColumn("root", F.coalesce("root", "node")))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_content = join_unique(named, ids, ["root"]).select("content", "component_id")
    return join_unique(marked, by_content, ["content"]).select("doc_id", "component_id")
