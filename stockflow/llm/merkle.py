"""Merkle manifest of a corpus: a binary hash tree for each language, a tree over their roots, proofs, and their verification.

A leaf is H of a row's fields, each as byte count, ``:`` and value, or ``-`` for null; H is SHA-256 in lowercase hex of its inputs'
concatenation.  The leaves of a tree ascend by key (equal keys by leaf).  Pairs of neighbours become their H level by level; the last
run of a level may be a single node, which is hashed alone.  The roots, in order of language (null first), are the leaves of the last tree.

Nodes are kept in a postorder log: a node is appended when its last leaf is in.  Before leaf j stand j leaves and floor(j/2) + floor(j/4)
+ ... = j - popcount(j) finished nodes, and the nodes that leaf j finishes follow it level by level, so a node's position has a closed
form (``position``) and a sibling is addressed without a search.  Builders are aligned: each appends the subtree over 2 ** ``BITS``
leaves of one tree, whose nodes lie next to each other in the log.  The roots of all builders are the leaves of the next tier, so a
tree of any size takes a few tiers, and no task holds more than one builder's leaves.  Proofs go the other way: a tier's siblings are
looked up in its logs and followed by the siblings of the tier above.

Defined cases: a null text differs from an empty one; rows of equal keys or equal rows are leaves of their own; a null key comes first
in its language; a null language is a tree of its own; a tree of one leaf has that leaf as its root; a row that is the whole corpus
has a proof without siblings; a null ``n_chars`` cannot be tampered with; an empty table gives an empty result; other columns do not count.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.frames import saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A builder's subtree has at most 2 ** BITS leaves.
BITS = 12
LEFT, RIGHT, ALONE = "<", ">", "="


def position(level: int, index: int, leaves: int) -> int:
    """Where node ``index`` of ``level`` stands in the log of a tree of ``leaves`` leaves."""
    last = min((index + 1) << level, leaves) - 1
    return 2 * last - last.bit_count() + level


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def join(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def append(leaves: Sequence[str], levels: int) -> list[str]:
    """The log of a subtree: its nodes up to ``levels`` above the leaves, in the order in which they are finished."""
    log: list[str] = []
    n = len(leaves)
    for i, node in enumerate(leaves):
        log.append(node)
        for level in range(levels):
            index = i >> level
            if index & 1:
                node = join(log[position(level, index - 1, n)], node)
            elif i == n - 1:
                node = join(node)
            else:
                break
            log.append(node)
    return log


def path(log: Sequence[str], leaf: int, leaves: int, levels: int) -> list[str]:
    """The steps from a leaf to the subtree's root: at each level the sibling with its side, or that there is none."""
    steps = []
    for level in range(levels):
        other = (leaf >> level) ^ 1
        if other << level >= leaves:
            steps.append(ALONE)
        else:
            steps.append((RIGHT if other & 1 else LEFT) + log[position(level, other, leaves)])
    return steps


def fold(leaf: str, steps: Sequence[str]) -> str:
    """The root that a leaf and a path lead to."""
    for step in steps:
        side, other = step[0], step[1:]
        leaf = join(other, leaf) if side == LEFT else join(leaf, other)
    return leaf


def leaf_hash(*fields: Column) -> Column:
    """H of the fields, each as its length in bytes, ``:`` and value, or ``-``."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves_of(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", tree: str = "lang", tampered: str = "n_chars", every: int = 7) -> DataFrame:
    """(tree, key, leaf, altered) of each row; ``altered`` is the leaf after tampering, null for rows that stay.

    ``tree`` is the language as text that sorts null first.
    """
    named = {f: docs[f"`{f}`"] for f in fields}
    more = named | {tampered: named[tampered].cast("decimal(38,0)") + 1}
    hit = (F.crc32(docs[f"`{key}`"].cast("string")) % every == 0) & named[tampered].isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("="), docs[f"`{tree}`"].cast("string")), F.lit("")).alias("tree"),
        docs[f"`{key}`"].alias("key"),
        leaf_hash(*named.values()).alias("leaf"),
        F.when(hit, leaf_hash(*more.values())).alias("altered"),
    )


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``rank`` (from 0) in its tree by ``order``, and the tree's number of leaves ``n``.

    Rows are dealt in ranges, so a tree that holds most rows is spread like any other; equal rows are told apart by a running number.
    What is counted is one row for each tree and range.
    """
    numbered = leaves.withColumn("number", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange("tree", *order, "number").sortWithinPartitions("tree", *order, "number")
    placed = saved(dealt.drop("number").withColumn("place", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("place", 33)
    parts = saved(placed.groupBy("tree", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("held")), "parts")
    whole = Window.partitionBy("tree")
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = saved(parts.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(whole).alias("n")), "starts")
    return placed.withColumn("part", part).join(starts, ["tree", "part"]).withColumn("rank", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


def _levels(n: int, bits: int) -> int:
    """Levels that a builder climbs in a tree of ``n`` leaves: all, if the tree has one builder only."""
    return min(height(n), bits)


def _append_logs(leaves: DataFrame, bits: int) -> DataFrame:
    """(tree, block, n, held, start, log): one row a builder; its log begins at ``start`` of the tier's log."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        n, rank = group["n"][0].as_py(), group["rank"][0].as_py()
        log = append(group["leaf"].to_pylist(), _levels(n, bits))
        row = {"tree": group["tree"][0].as_py(), "block": rank >> bits, "n": n, "held": len(group), "start": 2 * rank - rank.bit_count(), "log": log}
        return pa.Table.from_pylist([row])

    dealt = leaves.select("tree", "rank", "n", "leaf", F.shiftright("rank", bits).alias("block"))
    return dealt.groupBy("tree", "block").applyInArrow(build, "tree string, block long, n long, held long, start long, log array<string>")


def logs(leaves: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """The logs of each tier for ``leaves`` (tree, rank, n, leaf), the leaves' own first; each is a written table."""
    tiers, current = [], leaves
    while True:
        tier = saved(_append_logs(current, bits), "log")
        tiers.append(tier)
        tall = tier.filter(F.col("n") > 1 << bits)
        if tall.isEmpty():
            return tiers
        current = tall.select("tree", F.col("block").alias("rank"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), F.element_at("log", -1).alias("leaf"))


def roots(tiers: Sequence[DataFrame], bits: int = BITS) -> DataFrame:
    """(tree, root) from the tier at which each tree has one builder."""
    tops = [t.filter(F.col("n") <= 1 << bits).select("tree", F.element_at("log", -1).alias("root")) for t in tiers]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def _paths(tier: DataFrame, above: DataFrame | None, bits: int) -> DataFrame:
    """(tree, block, steps) of a tier's leaves, which are the builders of the tier below, up to the root of the tree."""

    def walk(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels, own = _levels(row["n"], bits), row["above"] or []
                steps = [path(row["log"], i, row["held"], levels) + own for i in range(row["held"])]
                first = row["block"] << bits
                yield pa.RecordBatch.from_pydict({"tree": [row["tree"]] * len(steps), "block": list(range(first, first + len(steps))), "steps": steps})

    joined = _with_above(tier, above)
    return joined.mapInArrow(walk, "tree string, block long, steps array<string>")


def _with_above(tier: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return tier.withColumn("above", F.lit(None).cast("array<string>"))
    return tier.join(above.withColumnRenamed("steps", "above"), ["tree", "block"], "left")


def _above(tiers: Sequence[DataFrame], bits: int) -> DataFrame | None:
    """(tree, block, steps) of the first tier's builders: their siblings in all tiers above, None if there is one tier only."""
    above = None
    for tier in reversed(tiers[1:]):
        above = saved(_paths(tier, above, bits), "paths")
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", tree: str = "lang", tampered: str = "n_chars", every: int = 7, bits: int = BITS) -> DataFrame:
    """(key, lang, leaf, altered, subroot, root, steps, folded) of each row.

    ``steps`` is the proof: siblings with their sides, from the leaf to the root over all languages; ``folded`` is the root that
    the altered leaf (the leaf, where none was altered) and the proof give.
    """
    own = saved(ranked(leaves_of(docs, fields, key, tree, tampered, every), ["key", "leaf"]), "ranked")
    tiers = logs(own, bits)
    subroots = saved(roots(tiers, bits), "subroots")
    # The languages' roots are the leaves of one more tree.
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"))
    tops = saved(ranked(named, ["key"]), "tops")
    top_tiers = logs(tops, bits)
    top_steps = _leaf_steps(tops.select("tree", "rank", "n", "leaf", F.col("key").alias("name")), top_tiers, bits, "name string")
    whole = saved(roots(top_tiers, bits), "root").select(F.col("root").alias("whole"))
    # One root for the corpus: a join on a constant, not on rows.
    top = top_steps.select(F.col("name").alias("tree"), F.col("steps").alias("top_steps"), F.col("leaf").alias("subroot"), F.lit(1).alias("one"))
    ends = saved(top.join(whole.withColumn("one", F.lit(1)), "one").drop("one"), "ends")
    kind = docs.schema[key].dataType.simpleString()
    rows = _leaf_steps(own.select("tree", "rank", "n", "leaf", "key", "altered"), tiers, bits, f"key {kind}, altered string", ends)
    return rows.select("key", F.expr("substring(tree, 2)").alias("name"), "tree", "leaf", "altered", "subroot", "root", "steps", "folded")


def _leaf_steps(leaves: DataFrame, tiers: Sequence[DataFrame], bits: int, extra: str, ends: DataFrame | None = None) -> DataFrame:
    """``leaves`` with ``steps`` to the root of their tree, or, with ``ends``, through it to the root of all trees, and the root folded from them."""
    names = [x.split(" ")[0] for x in extra.split(", ")]
    tier = _with_above(tiers[0], _above(tiers, bits))
    schema = f"tree string, leaf string, {extra}, steps array<string>"
    tier = tier.withColumnRenamed("tree", "log_tree").withColumnRenamed("block", "log_block").drop("n", "start")
    through = ends is not None
    if through:
        tier = tier.join(ends.withColumnRenamed("tree", "log_tree"), "log_tree")
        schema += ", subroot string, root string, folded string"
    wanted = [x.strip().split(" ")[0] for x in schema.split(",")]

    def walk(group: pa.Table, logs: pa.Table) -> pa.Table:
        if not len(group):
            return group.select(["tree", "leaf", *names]).append_column("steps", pa.array([], pa.list_(pa.string())))
        group = group.sort_by("rank")
        held, n = len(group), group["n"][0].as_py()
        (log,) = logs.to_pylist()
        levels = _levels(n, bits)
        top = (log["above"] or []) + (log["top_steps"] if through else [])
        steps = [path(log["log"], i, held, levels) + top for i in range(held)]
        columns = {c: group[c] for c in ["tree", "leaf", *names]} | {"steps": pa.array(steps, pa.list_(pa.string()))}
        if through:
            columns["subroot"], columns["root"] = (pa.array([log[c]] * held, pa.string()) for c in ("subroot", "whole"))
            given = zip(group["leaf"].to_pylist(), group["altered"].to_pylist(), steps)
            columns["folded"] = pa.array([fold(altered or leaf, s) for leaf, altered, s in given], pa.string())
        return pa.table({c: columns[c] for c in wanted})

    left = leaves.withColumn("block", F.shiftright("rank", bits)).groupBy("tree", "block")
    return left.cogroup(tier.groupBy("log_tree", "log_block")).applyInArrow(walk, schema)


def query_rows(docs: DataFrame) -> DataFrame:
    """Of each document: its leaf, the roots, a digest of its proof, and whether the proof holds after tampering."""
    siblings = F.transform("steps", lambda s: F.substring(s, 2, 64))
    return manifest(docs).select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
