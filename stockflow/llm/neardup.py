"""Near-duplicate rows of a corpus: SimHash fingerprints linked through BK-trees and by MinHash bands, every link verified exactly.

Words are those of ``simhash``; a text is the set of its shingles of ``SHINGLE`` words (a shorter text is one shingle, a text without
words the empty set).  Two texts are linked if the Jaccard similarity of their sets is at least 4/5 or the sets are equal; groups
are the components of the links.

A set's SimHash (each different shingle votes once) is searched as in ``simhash``: fingerprints within its radius are linked through the
BK-trees of shards of equal bit blocks, at most a link for each fingerprint of a cell, and sets of one fingerprint by its least set.  The
trees find near-equal texts; at similarity 0.8 most fingerprints differ in more bits, and a link stands for its group only, so bands complete them.

Candidates also share one of ``BANDS`` bands of ``WIDTH`` least hashes.  Sets of similarity s share none with probability
(1 - s ** WIDTH) ** BANDS: 7 in 100,000 at 0.8, fewer than one in a million at 0.85.  No candidate is taken on its sketch: every link is
verified on the whole sets.  First each set of a band's bucket meets the bucket's least one, at the cost of one pair for each set.  Buckets
that these links leave in several groups are then searched as a whole: in a cell, each set outside the largest group looks up the
sets that hold one of its n - ceil(0.8 n) + 1 rarest shingles (two of similarity 0.8 share one of those) and are in another group, and a
pair of groups is tied by one link.  So what a bucket emits is at most a link for each of its sets, never its pairs.  A bucket of more
than ``CELL`` shingles is dealt into parts that meet each other in cells of their own; buckets of the same sets are searched once.

Defined cases: null texts are read as empty; rows of equal ids are rows of their own; a null id is never the smallest unless its group
has no other; an empty table stays empty; columns beside id and text are kept and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm import simhash
from stockflow.llm.components import components
from stockflow.llm.frames import saved, shipped, slices
from stockflow.llm.simhash import first_of_groups, shingle_hashes

SHINGLE, BANDS, WIDTH = 5, 24, 5
#: Shingles sketched at a time, bytes of text whose sets are held together, and rows up to which a counted table is broadcast.
BLOCK, SLICE, SHIPPED = 1 << 10, 4 << 20, 1 << 18
#: Shingles of a part of a bucket; a cell holds two parts.
CELL = 1 << 21
_FACTORS = np.random.default_rng(42).integers(1 << 63, size=BANDS * WIDTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    blocks = [np.unique(h) for h in shingle_hashes((text or "").encode().lower(), SHINGLE)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band of least hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[i : i + BLOCK, None] * _FACTORS).min(0), out=least)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def print_of(shingles: np.ndarray) -> int:
    """The SimHash of a set, a bounded block of shingles at a time."""
    return simhash.voted(shingles[i : i + simhash.BLOCK] for i in range(0, len(shingles), simhash.BLOCK))


def _sketched(texts: DataFrame, kind: str) -> DataFrame:
    """(key, mark, bag, size, bands, fingerprint) of each row; rows of equal sets have one ``bag``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, sizes, found, prints = [], [], [], []
            for t in batch["text"]:
                own = shingle_set(t.as_py())
                sizes.append(len(own))
                bags.append(xxhash.xxh64_intdigest(own.tobytes()))
                found.append(bands(own))
                prints.append(print_of(own))
            arrays = [batch["key"], batch["mark"], pa.array(np.array(bags, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "mark", "bag", "size", "bands", "fingerprint"])

    return texts.mapInArrow(run, f"key {kind}, mark long, bag long, size long, bands array<long>, fingerprint long")


def _sets(texts: DataFrame) -> DataFrame:
    """(bag, shingles) of rows that hold ``bag`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch["text"], SLICE):
                found = [shingle_set(t.as_py()).view(np.int64) for t in part]
                yield pa.RecordBatch.from_arrays([batch["bag"].slice(done, len(part)), pa.array(found, pa.list_(pa.int64()))], ["bag", "shingles"])
                done += len(part)

    return texts.select("bag", "text").mapInArrow(run, "bag long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have a similarity of 4/5 at least, in whole numbers."""
    a, b = (sets.select(F.col("bag").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = pairs.join(b, "b").join(a, "a").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(5 * F.col("both") >= 4 * (F.size("of_a") + F.size("of_b") - F.col("both"))).select("a", "b")


def _slices(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of several runs."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())


def ties(sizes: np.ndarray, shingles: np.ndarray, group: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of a cell that tie its groups together as all links of similarity 4/5 would (of ``side``s that differ)."""
    n, ends = len(sizes), np.cumsum(sizes)
    _, ids, many = np.unique(shingles, return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    first = np.cumsum(many) - many
    _, group = np.unique(group, return_inverse=True)
    found = []
    for x in np.flatnonzero(group != np.bincount(group).argmax()):
        own = ids[ends[x] - sizes[x] : ends[x]]
        own = own[np.argsort(many[own], kind="stable")]
        rare = own[: sizes[x] - -(-4 * sizes[x] // 5) + 1]
        near = np.zeros(n, bool)
        near[holders[_slices(first[rare], many[rare])]] = True
        near &= (group != group[x]) & (4 * sizes <= 5 * sizes[x]) & (4 * sizes[x] <= 5 * sizes)
        if side is not None:
            near &= side != side[x]
        if near.any():
            both = np.bincount(holders[_slices(first[own], many[own])], minlength=n)
            for y in np.flatnonzero(near & (9 * both >= 4 * (sizes + sizes[x]))):
                if group[y] != group[x]:
                    found.append((x, y))
                    group[group == group[y]] = group[x]
    return found


def _searched(cells: DataFrame) -> DataFrame:
    """Links (a, b) of each cell of ``cells`` (band, x, y, part, bag, root, shingles)."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        bags, sets = cell["bag"].to_numpy(), cell["shingles"].chunk(0)
        sizes = sets.value_lengths().to_numpy().astype(np.int64)
        side = cell["part"].to_numpy() if cell["x"][0].as_py() != cell["y"][0].as_py() else None
        found = np.array(ties(sizes, sets.flatten().to_numpy(), cell["root"].to_numpy(), side), np.int64).reshape(-1, 2)
        return pa.table({"a": bags[found].min(1), "b": bags[found].max(1)})

    return cells.groupBy("band", "x", "y").applyInArrow(run, "a long, b long")


def tree_pairs(different: DataFrame) -> DataFrame:
    """Pairs (a, b) of bags of ``different`` (bag, size, fingerprint) to verify: linked through BK-trees, or of one fingerprint."""
    printed = different.filter("size > 0").select("bag", "fingerprint")
    least = saved(printed.groupBy("fingerprint").agg(F.min("bag").alias("least")), "prints")
    linked = saved(simhash.links(least.select("fingerprint")).distinct(), "tree_links")
    a, b = (least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"bag_{c}")) for c in "ab")
    pairs = linked.join(a, "a").join(b, "b").select(F.col("bag_a").alias("a"), F.col("bag_b").alias("b"))
    equal = printed.join(least, "fingerprint").filter("bag <> least").select(F.col("least").alias("a"), F.col("bag").alias("b"))
    return pairs.union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(different: DataFrame, sets_of) -> DataFrame:
    """Links (a, b) that span the groups of ``different`` (bag, size, bands, fingerprint); ``sets_of(bags)`` gives (bag, shingles) of some bags."""
    trees = saved(tree_pairs(different), "trees")
    spread = saved(different.select("bag", "size", F.explode("bands").alias("band")), "bands")
    least = spread.groupBy("band").agg(F.min("bag").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "least")
    buckets = saved(spread.join(saved(least, "least"), "band"), "buckets")
    sets = saved(sets_of(buckets.select("bag").union(trees.select("a")).union(trees.select("b")).distinct()), "sets")
    first = buckets.filter("bag <> least").select(F.col("least").alias("a"), F.col("bag").alias("b"))
    near = saved(_verified(trees.union(first).distinct(), sets), "near")
    roots = saved(components(near), "roots").withColumnRenamed("node", "bag")
    rooted = saved(buckets.join(roots, "bag", "left").select("band", "bag", "size", F.coalesce("root", "bag").alias("root")), "rooted")
    same = [F.bit_xor(F.xxhash64("bag", F.lit(seed))).alias(f"same_{seed}") for seed in (1, 2)]
    spans = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("held"), *same).filter("low <> high")
    spans = spans.groupBy("same_1", "same_2", "held").agg(F.min("band").alias("band"))
    parts = saved(spans.select("band", F.ceil(F.col("held") / CELL).cast("int").alias("parts")), "spans")
    dealt = rooted.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("bag"), F.col("parts")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("band", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "bag", "root")
    return near.union(_searched(cells.join(sets, "bag")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest key stays (of equal keys, the least text hash)."""
    mark = F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit("")))
    texts = docs.select(docs[f"`{key}`"].alias("key"), mark.alias("mark"), docs[f"`{text}`"].alias("text"))
    rows = saved(_sketched(texts, docs.schema[key].dataType.simpleString()), "sketches")
    different = saved(rows.groupBy("bag").agg(F.min("mark").alias("mark"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fingerprint").alias("fingerprint")), "different")

    def sets_of(bags: DataFrame) -> DataFrame:
        # One text stands for all of equal sets.
        wanted = saved(different.select("bag", "mark").join(bags, "bag"), "wanted")
        held = texts.select("mark", "text").join(shipped(wanted, wanted.count(), SHIPPED), "mark")
        return _sets(held.dropDuplicates(["bag"]))

    nodes = saved(components(saved(links(different.select("bag", "size", "bands", "fingerprint"), sets_of), "near")), "components")
    named = rows.select("key", "mark", "bag").join(nodes.withColumnRenamed("node", "bag"), "bag", "left")
    return first_of_groups(docs, named.select("key", "mark", F.coalesce("root", "bag").alias("root")), key, mark)
