"""Near-duplicate groups: 64-bit SimHash of word shingles, linked within a Hamming radius through BK-trees.

Texts have A-Z lower-cased; words are runs without ASCII white space; a shingle is ``SHINGLE`` words joined by spaces, repeats
included (a shorter text is one shingle, a text without words has fingerprint zero).  A bit of the fingerprint is 1 if it is
set in over half of the shingles' XXH64 values (seed 42).

Links are searched among distinct fingerprints.  ``radius`` + 1 blocks of bits are cut from a fingerprint; two within the radius
agree on a whole block, so the fingerprints that share a block's value form a shard, and all links lie inside shards.  A shard's
tree is a BK-tree: children are keyed by their Hamming distance to the parent, and a search at distance d follows the edges
d - radius to d + radius only.  Trees hold at most ``TREE`` fingerprints: a larger shard is cut into several, and each tree
is sent to the pieces of its own shard only, so what a task receives is bounded.  What a search finds is folded into components
at once: a cell emits at most one link for each of its values, never all pairs.

Defined cases: null texts are read as empty; rows of equal ids are rows of their own, with one fingerprint each; a null id is never
the smallest unless its group has no other; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stockflow.llm.components import components
from stockflow.llm.frames import saved

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one tree, and shingles hashed at a time.
TREE, BLOCK = 4096, 1 << 16
#: Rows of small shards that share a cell.
BUNDLE = 1 << 15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 values of the shingles of ``text``, in blocks; nothing for a text without words."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    found = (m.group() for m in _WORD.finditer(text)) if len(text) > 1 << 22 else iter(_WORD.findall(text))
    words = list(islice(found, BLOCK + size - 1))
    if words and len(words) < size:
        yield np.array([digest(join(words), SEED)], np.uint64)
    while len(words) >= size:
        yield np.array([digest(join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)], np.uint64)
        words = words[len(words) - size + 1 :] + list(islice(found, BLOCK))


def voted(blocks: Iterable[np.ndarray]) -> int:
    """The signed fingerprint of hashes that come in blocks: a bit is 1 if it is set in over half of them."""
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        total += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return voted(shingle_hashes((text or "").encode().lower(), size))


def with_fingerprint(df: DataFrame, text: str = "text", output: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """``df`` with the signed 64-bit fingerprint of ``text`` (a column of that name is replaced)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), size) for t in batch], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(output, F.arrow_udf(run, LongType())(df[f"`{text}`"]))


class BKTrees:
    """BK-trees over the fingerprints of several shards, held in arrays so that many searches go down them together.

    The first value of a shard is its root.  The children of a node are adjacent in ``order`` and sorted by their edge, the
    distance to the parent, so a search follows one slice of edges per node.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values, n = values, len(values)
        self.shards, first, which = np.unique(shard, return_index=True, return_inverse=True)
        self.roots = first
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        waiting = np.ones(n, bool)
        waiting[first] = False
        waiting = np.flatnonzero(waiting)
        at = first[which][waiting]
        while len(waiting):
            # Those that meet the same node at the same distance go down together; the first of them becomes the child.
            d = np.bitwise_count(values[waiting] ^ values[at]).astype(np.int64)
            _, head, place = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = waiting[head]
            parent[child], edge[child] = at[head], d[head]
            rest = np.ones(len(waiting), bool)
            rest[head] = False
            waiting, at = waiting[rest], child[place][rest]
        self.order = np.argsort(parent * 65 + edge, kind="stable")
        self.key = (parent * 65 + edge)[self.order]

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) positions within ``radius`` inside a shard, level by level."""
        if not len(self.values):
            return
        place = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        q = np.flatnonzero(self.shards[place] == shard)
        node = self.roots[place[q]]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 1))
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            many = high - low
            start = np.repeat(low - (np.cumsum(many) - many), many)
            q, node = np.repeat(q, many), self.order[start + np.arange(len(start))]


def _tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each node's least fellow) after tying a to b: larger roots hang on smaller ones until all agree."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def tree_links(tree: np.ndarray, tree_shard: np.ndarray, queries: np.ndarray, query_shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie the same fingerprints together as all pairs (tree value, query) of a shard within ``radius`` would.

    At most one link for each value: pairs are folded into components as the search yields them, a bounded batch at a time.
    """
    values, where = np.unique(np.concatenate([tree, queries]), return_inverse=True)
    in_tree, in_queries = where[: len(tree)], where[len(tree) :]
    trees, root = BKTrees(tree, tree_shard), np.arange(len(values))
    largest = int(np.unique(tree_shard, return_counts=True)[1].max(initial=1))
    step = max(64, (1 << 20) // largest)
    for i in range(0, len(queries), step):
        for q, node in trees.search(queries[i : i + step], query_shard[i : i + step], radius):
            root = _tie(root, in_queries[i + q], in_tree[node])
    tied = np.flatnonzero(root != np.arange(len(root)))
    return values[tied], values[root[tied]]


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``parts`` blocks of the 64 bits, nearly equal in width."""
    ends = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(ends[:-1], ends[1:])]


def links(fingerprints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) between the distinct values of ``fingerprint`` that span the components of "at most ``radius`` bits differ".

    Small shards are bundled into cells of some ``BUNDLE`` rows.  A shard larger than a tree is dealt into parts; the tree of a
    part meets itself and each later part in a cell of its own, so no cell grows with its shard.
    """
    shard = F.array(*[F.xxhash64(F.lit(i), F.expr(f"shiftrightunsigned(fingerprint, {s}) & {mask}L")) for i, (s, mask) in enumerate(_blocks(radius + 1))])
    rows = fingerprints.select("fingerprint", F.explode(shard).alias("shard"))
    total = fingerprints.count() * (radius + 1)
    large = saved(rows.groupBy("shard").count().filter(F.col("count") > tree).select("shard", F.ceil(F.col("count") / tree).cast("int").alias("parts")), "shards")
    rows = rows.join(large, "shard", "left")
    small = rows.filter("parts is null").select(F.pmod("shard", F.lit(total // BUNDLE + 1)).alias("cell"), F.lit(0).alias("x"), F.lit(0).alias("y"), "shard", "fingerprint", F.lit(True).alias("in_tree"))
    big = rows.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    # In cell (x, y) part x gives the tree and part y the queries, x <= y.
    as_tree = big.select("shard", F.col("part").alias("x"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("y"), "fingerprint", F.lit(True).alias("in_tree"))
    as_query = big.filter("part > 0").select("shard", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("x"), F.col("part").alias("y"), "fingerprint", F.lit(False).alias("in_tree"))
    cells = small.unionByName(as_tree.union(as_query).select(F.col("shard").alias("cell"), "x", "y", "shard", "fingerprint", "in_tree"))

    def run(cell: pa.Table) -> pa.Table:
        values = cell["fingerprint"].to_numpy().view(np.uint64)
        mine, own = cell["in_tree"].to_numpy(), cell["shard"].to_numpy()
        asked = np.ones(len(values), bool) if mine.all() else ~mine
        a, b = tree_links(values[mine], own[mine], values[asked], own[asked], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("cell", "x", "y").applyInArrow(run, "a long, b long")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) for each row: the smallest key that links reach, the row's own included."""
    prints = with_fingerprint(df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text")), "text", "fingerprint", size)
    return labelled(saved(prints.select("key", "fingerprint"), "fingerprints"), radius).withColumnRenamed("key", key)


def labelled(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``groups`` for rows that hold ``key`` and ``fingerprint`` already."""
    distinct = saved(prints.groupBy("fingerprint").agg(F.min("key").alias("least")), "distinct")
    nodes = saved(components(links(distinct.select("fingerprint"), radius)), "components")
    tied = nodes.join(distinct, nodes["node"] == distinct["fingerprint"]).select("fingerprint", "root", "least")
    roots = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    named = distinct.join(tied.join(roots, "root").select("fingerprint", "component_id", "root"), "fingerprint", "left")
    named = named.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    # Written, so that this join stands between two plain exchanges and a frequent fingerprint can be split.
    return prints.join(saved(named, "named"), "fingerprint")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest key stays (of equal keys, the least text hash)."""
    mark = F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit("")))
    prints = with_fingerprint(docs.select(docs[f"`{key}`"].alias("key"), mark.alias("mark"), docs[f"`{text}`"].alias("text")), "text", "fingerprint", size)
    prints = saved(prints.select("key", "mark", "fingerprint"), "fingerprints")
    return first_of_groups(docs, labelled(prints, radius), key, mark)


def first_of_groups(docs: DataFrame, rows: DataFrame, key: str, mark: Column) -> DataFrame:
    """Of ``docs``, the row with the smallest key of each ``root`` in ``rows`` (key, mark, root); of equal keys, the least ``mark``."""
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("best"))
    best = saved(best.select(F.col("best.key").alias("__key"), F.col("best.mark").alias("__mark")), "representatives")
    kept = docs.withColumn("__row_mark", mark).join(best, docs[f"`{key}`"].eqNullSafe(F.col("__key")) & (F.col("__row_mark") == F.col("__mark")), "left_semi")
    return kept.dropDuplicates([key, "__row_mark"]).drop("__row_mark")


def query_rows(docs: DataFrame) -> DataFrame:
    """Of each document: fingerprint as 16 hexadecimal digits, and its component."""
    return groups(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
