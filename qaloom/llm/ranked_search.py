"""Ranked lexical search: exact top documents of each item by NRA over impact-sorted lists.

The corpus is read once and becomes an index: shards of a bounded number of documents and terms, each with
its documents' lengths and, per term, the documents that hold it and how often. Only terms that the items may hold are
indexed: they pass a bitmap of fixed size, made of hashes of the items' terms. Corpus statistics are sums over the shards.

The items go out in blocks of bounded size (a stated query set). A shard sorts each list by impact and reads the lists of an item
in step, from the highest impact down (no random access): every document that was seen has a lower bound, the impacts read so far, and an upper
bound, which adds the next impact of each list it was not seen in. Reading goes on until no unseen document can reach the floor (the
least score that can still be among the best, carried on from shard to shard), and every document that can has equal bounds, so
membership, ties and scores are final. The best of each task meet in two steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from qaloom.operators.skew import join_unique, range_rank
from qaloom.session import cut

#: Results of each item.
TOP = 50
#: Documents and indexed (term, document) pairs of a shard, bits of the bitmap of the items' terms, terms of a block of items.
SHARD_DOCS, SHARD_PAIRS, BITMAP, BLOCK_TERMS = 8192, 1 << 19, 20, 100_000
#: Impacts read from each list in the first round; each round reads twice as many.
FIRST = 32
#: Terms whose place in the bitmap a task remembers; past that it starts anew.
REMEMBERED = 1_000_000
#: Slices in which the tasks' best meet first.
SLICES = 64
#: A-Z in lower case, letters, digits and all bytes beyond ASCII as they are, a blank for anything else.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM).split()


def bucket(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - BITMAP)


INDEX = "docs array<{kind}>, lengths array<bigint>, terms array<binary>, starts array<int>, holders array<int>, counts array<int>"


class Shard:
    """A shard in the making."""

    def __init__(self):
        self.docs, self.lengths, self.pairs, self.lists = [], [], 0, {}

    def add(self, doc_id, found: list[bytes], wanted) -> None:
        at = len(self.docs)
        self.docs.append(doc_id)
        self.lengths.append(len(found))
        for term, count in Counter(found).items():
            if wanted(term):
                self.lists.setdefault(term, []).append((at, count))
                self.pairs += 1

    def full(self) -> bool:
        return len(self.docs) >= SHARD_DOCS or self.pairs >= SHARD_PAIRS

    def row(self) -> tuple:
        starts = np.cumsum([0, *map(len, self.lists.values())]).tolist()
        flat = [pair for held in self.lists.values() for pair in held]
        return self.docs, self.lengths, list(self.lists), starts, [d for d, _ in flat], [c for _, c in flat]


def index(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard of the documents, with the terms that ``items`` (column ``terms``) may hold."""

    def places(column):
        for batch in column:
            found = {bucket(t) for held in batch.column(0).to_pylist() for t in held}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["b"])

    # At most 2 ** BITMAP numbers, whatever the number of items.
    held = np.zeros(1 << BITMAP, bool)
    held[[r.b for r in items.select("terms").mapInArrow(places, "b int").distinct().collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(held))
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = to_arrow_type(frame.schema["doc_id"].dataType)
    kinds = [pa.list_(x) for x in (kind, pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())]
    schema = INDEX.format(kind=dict(frame.dtypes)["doc_id"])
    names = [part.split()[0] for part in schema.split(", ")]

    def put(shard: Shard) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values], k) for values, k in zip(shard.row(), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        known: dict[bytes, bool] = {}

        def wanted(term: bytes) -> bool:
            if term not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[term] = bool(bits[bucket(term)])
            return known[term]

        shard = Shard()
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(key, terms(raw), wanted)
                if shard.full():
                    yield put(shard)
                    shard = Shard()
        if shard.docs:
            yield put(shard)

    return frame.mapInArrow(run, schema)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all whose score is above 0 and at least both ``floor`` and the ``most``-th best.

    ``lists`` hold documents (0 to ``size`` - 1) and their impacts, highest first. Each is read from its start, in step with the others.
    """
    lists = [(doc, impact) for doc, impact in lists if len(doc) and impact[0] > 0]
    lower, seen = np.zeros(size, np.int64), np.zeros((size, len(lists)), bool)
    live, least, at, step = None, max(floor, 1), 0, FIRST
    while True:
        for k, (doc, impact) in enumerate(lists):
            own = doc[at:at + step]
            lower[own] += impact[at:at + step]
            seen[own, k] = True
        at, step = at + step, 2 * step
        heads = np.array([impact[at] if at < len(impact) else 0 for _, impact in lists], np.int64)
        held = np.flatnonzero(lower) if live is None else live
        if len(held) >= most:
            least = max(least, int(np.partition(lower[held], len(held) - most)[len(held) - most]))
        # A document not seen so far has at most all next impacts together.
        if live is None and heads.any() and heads.sum() >= least:
            continue
        upper = lower[held] + ~seen[held] @ heads
        live = held[upper >= least]
        if (upper[upper >= least] == lower[live]).all():
            return live, lower[live]


class Reader:
    """The lists of one shard by term, sorted by impact when first asked for."""

    def __init__(self, row: dict, documents: int, total: int):
        lengths = np.array(row["lengths"], np.int64)
        self.docs, self.starts = row["docs"], row["starts"]
        self.holders, self.counts = np.array(row["holders"], np.int64), np.array(row["counts"], np.int64)
        self.scale = 20 * (50 + 50 * lengths * documents // max(total, 1))
        self.place = {term: k for k, term in enumerate(row["terms"])}
        self.sorted: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impact of the term without its weight), highest first."""
        if term not in self.sorted:
            k = self.place[term]
            own = slice(self.starts[k], self.starts[k + 1])
            doc, count = self.holders[own], self.counts[own]
            impact = 1_000_000_000 * count // (1000 * count + self.scale[doc])
            order = np.argsort(-impact, kind="stable")
            self.sorted[term] = doc[order], impact[order]
        return self.sorted[term]

    def best(self, weighted: list[tuple[bytes, int]], most: int, floor: int) -> list[tuple]:
        """(doc_id, score) of the documents that can be among the best."""
        lists = [(doc, weight * impact) for term, weight in weighted if term in self.place for doc, impact in [self.read(term)]]
        if not lists:
            return []
        found, scores = nra(lists, len(self.docs), most, floor)
        return [(self.docs[d], s) for d, s in zip(found.tolist(), scores.tolist())]


def _order(hit: tuple) -> tuple:
    """Highest score first, then by ascending id, null first."""
    return -hit[1], hit[0] is not None, hit[0]


def items_of(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(number, item_id, terms): the distinct items with their distinct terms."""
    held = queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    kind = dict(held.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["number", "item_id", "terms"])

    numbered = range_rank(held, ["item_id", "text"], "number").select("number", "item_id", "text")
    return numbered.mapInArrow(run, f"number bigint, item_id {kind}, terms array<binary>")


def weighted_items(items: DataFrame, shards: DataFrame, documents: int) -> DataFrame:
    """(number, item_id, terms, weights): the items' terms that some document holds, by weight."""
    holding = F.expr("transform(sequence(0, size(terms) - 1), i -> starts[i + 1] - starts[i])")
    counts = shards.where("size(terms) > 0").select(F.explode(F.arrays_zip("terms", holding.alias("n"))).alias("x"))
    counts = counts.select(F.col("x.terms").alias("term"), F.col("x.n").cast("bigint").alias("n"))
    asked = items.select("number", "item_id", F.explode("terms").alias("term"))
    known = counts.groupBy("term").agg(F.sum("n").alias("df"))
    known = known.join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * documents + 2) / (2 * F.col("df") + 1)).cast("double")))
    found = join_unique(asked, known, ["term"], "inner").withColumn("weight", weight.cast("bigint")).where("weight > 0")
    lists = found.groupBy("number").agg(
        F.first("item_id").alias("item_id"), F.array_sort(F.collect_list(F.struct("weight", "term"))).alias("held"))
    return lists.select("number", "item_id", "held.term", "held.weight")


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``BLOCK_TERMS`` terms (or one item), read partition by partition."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row.term) > BLOCK_TERMS:
            yield held
            held, size = [], 0
        held.append((row.number, row.item_id, [(bytes(t), w) for t, w in zip(row.term, row.weight)]))
        size += len(row.term)
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, most: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of each item, all if fewer score above 0.

    Equal scores go by ascending id, null first. A null or empty text has no term, an item without a term no result; repeated
    rows of documents are documents of their own, repeated rows of items are one item, items of one id with different texts are
    ranked each on its own; other columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = cut(items_of(queries, item_id, item_text))
    shards = cut(index(docs, items, doc_id, text))
    documents, total = shards.agg(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0)).cast("bigint")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n))
    ).first()
    documents, total = documents or 0, total or 0
    kinds = {"number": pa.int64(), "item_id": to_arrow_type(items.schema["item_id"].dataType),
             "doc_id": to_arrow_type(shards.schema["docs"].dataType.elementType), "score": pa.int64(), "slice": pa.int32()}
    schema = (f"number bigint, item_id {dict(items.dtypes)['item_id']}, "
              f"doc_id {shards.schema['docs'].dataType.elementType.simpleString()}, score bigint, slice int")
    found = spark.createDataFrame([], schema)
    for block in blocks(cut(weighted_items(items, shards, documents))):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {number: [] for number, _, _ in shared.value}
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = Reader(batch.slice(k, 1).to_pylist()[0], documents, total)
                    for number, _, weighted in shared.value:
                        held = best[number]
                        floor = held[-1][1] if len(held) == most else 0
                        if more := shard.best(weighted, most, floor):
                            best[number] = sorted(held + more, key=_order)[:most]
            part = TaskContext.get().partitionId() % SLICES
            for number, item, _ in shared.value:
                if best[number]:
                    columns = zip(*((number, item, d, s, part) for d, s in best[number]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

        found = found.unionByName(cut(shards.mapInArrow(run, schema)))
        shared.unpersist()

    def best(rows: DataFrame, *by: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    return best(best(found, "number", "slice"), "number").select("item_id", "rank", "doc_id", "score")
