"""Connected components of a links table, by alternating star contractions; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.frames import saved


def _rehang(links: DataFrame, node: str, other: str, keep_larger: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them and the node itself.

    The least neighbour is a partial aggregate, and the join back is one row a node against its links, which Spark can split:
    a node with a third of all links is no task of its own.
    """
    least = links.groupBy(node).agg(F.least(F.min(other), F.first(node)).alias("root"))
    joined = links.join(least, node)
    if keep_larger:
        hung = joined.filter(F.col(other) > F.col(node)).select(F.col(other).alias("a"), F.col("root").alias("b"))
        return hung.filter("a <> b").distinct()
    hung = joined.select(F.col(other).alias("a"), F.col("root").alias("b")).union(least.select(F.col(node).alias("a"), F.col("root").alias("b")))
    return hung.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``links``, ``root`` being the least node of its component.

    Each round writes the remaining links, at most as many as before, to the shared folder; a round's job reads only that
    table.  Rounds grow with the logarithm of the longest chain.  Self links are nodes of their own; nulls link nothing.
    """
    nodes = links.select(F.col(a).alias("node")).union(links.select(F.col(b).alias("node"))).filter("node is not null").distinct()
    current = saved(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("a <> b").distinct(),
        "links",
    )
    last = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _rehang(both, "a", "b", keep_larger=True)
        current = saved(_rehang(large, "a", "b", keep_larger=False), "links")
        # Two exact sums tell whether a round changed anything: contraction only ever lowers roots.
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return nodes.join(current, nodes["node"] == current["a"], "left").select("node", F.coalesce("b", "node").alias("root"))
