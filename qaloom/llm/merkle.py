"""Merkle manifest of a dataset: one tree per source, one tree over the sources, and proofs of every row.

A node is the SHA-256 (as hex text) of up to 16 nodes below it. Trees are built level by level as grouped
aggregates of 16 rows, so a hot source costs no more per task than many small ones.

Proofs are made as octopus multiproofs. The leaves, in the order of their places, are cut into leaf partitions of a
fixed number. A partition works out which coordinates (tree, level, place) its leaves need and cannot derive from
each other, the least union for all of them; these are fetched by one join with the nodes; shared interiors are
derived once, and the proof of each leaf is expanded from them where it stands.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from qaloom.operators.skew import join_unique, range_rank
from qaloom.session import cut

#: Nodes under one node, and leaves of one leaf partition.
ARITY, PART = 16, 4096
#: The number of the tree over the sources; those of the sources count from 0.
TOP = -1


def hashed(text: Iterable[str] | str) -> str:
    """H: the lowercase hex SHA-256 of texts put together."""
    return sha256("".join(text).encode()).hexdigest()


def digest(*values: Column) -> Column:
    """H of the values of a row, each ``-`` if null, else its UTF-8 byte count, a colon, and itself."""
    def put(value: Column) -> Column:
        held = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(held).cast("string"), F.lit(":"), held), F.lit("-"))

    return F.sha2(F.concat(*map(put, values)), 256)


def leaves(docs: DataFrame, presented_text: Column | None = None, doc_id: str = "doc_id", source: str = "source",
           lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """(doc_id, tree_key, leaf, presented): the leaf of each row, and the leaf of the row as it is presented for a check.

    ``presented_text`` is the text that is presented where it is not null (a null of it: the text itself).
    ``tree_key`` orders the sources with null first.
    """
    def named(value: Column) -> Column:
        return F.unhex(digest(F.col(doc_id), F.col(source), F.col(lang), F.col(n_chars), value))

    leaf = named(F.col(text))
    key = F.coalesce(F.concat(F.lit("+"), F.col(source)), F.lit(""))
    presented = F.lit(None).cast("binary") if presented_text is None else F.when(presented_text.isNotNull(), named(presented_text))
    return docs.select(F.col(doc_id).alias("doc_id"), key.alias("tree_key"), leaf.alias("leaf"), presented.alias("presented"))


def _raised(nodes: DataFrame) -> DataFrame:
    """The level above nodes (tree, level, place, size, hash); trees of one node have none."""
    run = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.lower(F.hex(x.hash)))
    up = F.expr(f"place div {ARITY}")
    return (
        nodes.where("size > 1").groupBy("tree", up.alias("up"), "size", "level").agg(F.sha2(F.array_join(run, ""), 256).alias("h"))
        .select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("place"),
                F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"), F.unhex("h").alias("hash"))
    )


def _grown(base: DataFrame, largest: int) -> list[DataFrame]:
    """The levels over a base of nodes, up to the last node of a tree of ``largest`` leaves."""
    levels = [base]
    while largest > 1:
        levels.append(cut(_raised(levels[-1])))
        largest = -(-largest // ARITY)
    return levels


def _together(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


@dataclass(frozen=True)
class Manifest:
    """placed: (place_of_all, doc_id, tree, place, size, leaf, presented); nodes: (tree, level, place, size, hash);
    sources: (tree_key, tree, size); the root (None without rows) and the number of trees."""

    placed: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None
    trees: int


def manifest(rows: DataFrame) -> Manifest:
    """The trees over ``leaves``. Leaves of a source ascend by id (null first), those of one id by their digest."""
    placed = range_rank(rows, ["tree_key", "doc_id", "leaf"], "place_of_all")
    spans = placed.groupBy("tree_key").agg(F.min("place_of_all").alias("begin"), F.count(F.lit(1)).alias("size"))
    sources = cut(range_rank(spans, ["tree_key"], "tree"))
    trees, largest = sources.agg(F.count(F.lit(1)), F.max("size")).first()
    placed = cut(join_unique(placed, sources, ["tree_key"], "inner").select(
        "place_of_all", "doc_id", "tree", (F.col("place_of_all") - F.col("begin")).alias("place"), "size", "leaf", "presented"))
    base = placed.select("tree", F.lit(0).alias("level"), "place", "size", F.col("leaf").alias("hash"))
    levels = _grown(base, largest or 0)
    subroots = _together([level.where("size = 1") for level in levels])
    top = subroots.select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"),
        F.lit(trees).cast("bigint").alias("size"), "hash")
    over = _grown(cut(top), trees)
    last = over[-1].where("size = 1").select(F.lower(F.hex("hash"))).first()
    return Manifest(placed, _together(levels + over), sources.drop("begin"), last and last[0], trees)


def plan(places: Iterable[tuple[int, int]], sizes: dict[int, int], trees: int) -> tuple[list, list]:
    """(coordinates to fetch, runs to derive) for leaves (tree, place): the least that proves them all.

    A run is (tree, level, place of the node above, members); the runs come in the order they can be derived in, and the node
    (TOP, 0, t) is the subroot of tree t.
    """
    fetched, runs = [], []

    def climb(tree: int, known: set[int], size: int) -> None:
        level = 0
        while size > 1:
            above = sorted({k // ARITY for k in known})
            for up in above:
                members = range(up * ARITY, min((up + 1) * ARITY, size))
                runs.append((tree, level, up, members))
                fetched.extend((tree, level, k) for k in members if k not in known)
            known, size, level = set(above), -(-size // ARITY), level + 1

    by_tree: dict[int, set[int]] = {}
    for tree, place in places:
        by_tree.setdefault(tree, set()).add(place)
    for tree in sorted(by_tree):
        climb(tree, by_tree[tree], sizes[tree])
    climb(TOP, set(by_tree), trees)
    return fetched, runs


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


class Proofs:
    """The proofs of the leaves of one partition, expanded from what was fetched and derived."""

    def __init__(self, own: dict[tuple, str], fetched: dict[tuple, str], sizes: dict[int, int], trees: int):
        self.sizes, self.trees = sizes, trees
        nodes = {**fetched, **{(t, 0, k): h for (t, k), h in own.items()}}
        nodes |= {(TOP, 0, t): nodes[t, 0, 0] for t, size in sizes.items() if size == 1}
        self.beside: dict[tuple, tuple[str, str]] = {}
        for tree, level, up, members in plan(own, sizes, trees)[1]:
            row = [nodes[tree, level, k] for k in members]
            for at, k in enumerate(members):
                self.beside[tree, level, k] = "".join(row[:at]), "".join(row[at + 1:])
            nodes[tree, level + 1, up] = made = hashed(row)
            if tree != TOP and level + 1 == height(sizes[tree]):
                nodes[TOP, 0, tree] = made
        self.nodes = nodes

    def steps(self, tree: int, place: int) -> list[tuple[str, str]]:
        """(siblings to the left, to the right) on the way from a leaf to the root."""
        own = [self.beside[tree, level, place // ARITY ** level] for level in range(height(self.sizes[tree]))]
        return own + [self.beside[TOP, level, tree // ARITY ** level] for level in range(height(self.trees))]

    def subroot(self, tree: int) -> str:
        return self.nodes[TOP, 0, tree]


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in steps:
        leaf = hashed((left, leaf, right))
    return leaf


def _hexes(column: pa.ChunkedArray) -> list[str | None]:
    return [None if x is None else x.hex() for x in column.to_pylist()]


def verify(made: Manifest, wanted: Column | None = None, part: int = PART, siblings: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, or of the ``wanted`` ones.

    ``folded_root`` follows from the presented leaf (the own one, where none is) and the siblings of the manifest; ``proof_sha256``
    is H of the siblings, level by level from left to right. With ``siblings`` they are returned too (column ``proof``).
    Repeated rows are leaves of their own; a null id is a value like any other, and so is a null source; other columns
    of the table are ignored. An empty table gives an empty result.
    """
    rows = made.placed if wanted is None else made.placed.where(wanted)
    rows = rows.withColumn("part", F.expr(f"place_of_all div {part}")).drop("place_of_all")
    kind = dict(rows.dtypes)["doc_id"]
    arrow_kind = to_arrow_type(rows.schema["doc_id"].dataType)
    root, trees = made.root, made.trees

    def needs(table: pa.Table) -> pa.Table:
        tree, place, size, number = (table.column(c).to_pylist() for c in ("tree", "place", "size", "part"))
        found = plan(zip(tree, place), dict(zip(tree, size)), trees)[0]
        columns = [[number[0]] * len(found), *(zip(*found) if found else ([], [], []))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "tree", "level", "place"])

    def expand(table: pa.Table, got: pa.Table) -> pa.Table:
        tree, place, size = (table.column(c).to_pylist() for c in ("tree", "place", "size"))
        leaf, presented = _hexes(table.column("leaf")), _hexes(table.column("presented"))
        coordinates = zip(*(got.column(c).to_pylist() for c in ("tree", "level", "place")))
        proofs = Proofs(dict(zip(zip(tree, place), leaf)), dict(zip(coordinates, _hexes(got.column("hash")))), dict(zip(tree, size)), trees)
        rows = []
        for t, k, own, shown in zip(tree, place, leaf, presented):
            steps = proofs.steps(t, k)
            flat = "".join(left + right for left, right in steps)
            folded = fold(shown or own, steps)
            out = (own, proofs.subroot(t), root, hashed(flat), folded, folded == root)
            rows.append((*out, [flat[k:k + 64] for k in range(0, len(flat), 64)]) if siblings else out)
        kinds = [pa.string()] * 5 + [pa.bool_()] + [pa.list_(pa.string())] * siblings
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
        return pa.table([table.column("doc_id").cast(arrow_kind), *columns], names=names)

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * siblings
    asked = rows.select("part", "tree", "place", "size").groupBy("part").applyInArrow(
        needs, "part bigint, tree bigint, level int, place bigint")
    # Nodes near the root are asked for by every partition.
    got = join_unique(asked, made.nodes.drop("size"), ["tree", "level", "place"], "inner")
    return rows.groupBy("part").cogroup(got.groupBy("part")).applyInArrow(
        expand, schema + ", proof array<string>" * siblings)
