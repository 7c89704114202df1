"""Exact interpolated quantiles for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.operators.ordered import HOT_ROWS, largest_group, running_total, same_keys
from stockflow.session import store

BUFFER_ROWS = 100_000  # rows of one group whose distinct values may sit in one aggregation buffer
ACCURACY = 5_000  # of the sketch that brackets a quantile
MARGIN = 0.0005  # rank share added on both sides of a bracket, above the sketch's error


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), buffer_rows: int = BUFFER_ROWS, rows: int | None = None
) -> DataFrame:
    """One row per group; each column becomes the array of its quantiles at ``probs`` (linear interpolation).

    The built-in ``percentile`` keeps a group's distinct values in one buffer, so it serves only
    groups measured to be small (``rows``: the largest group's size, if known).  Larger ones are bracketed by
    a quantile sketch; ranks are counted exactly and only the values inside the brackets are sorted.
    """
    largest = largest_group(df, by) if rows is None else rows
    if largest <= buffer_rows:
        wanted = [F.percentile(F.col(c).cast("double"), list(probs)).alias(c) for c in columns]
        return df.groupBy(*by).agg(*wanted)
    return _bracketed(df, list(columns), list(probs), list(by))


def _bracketed(df: DataFrame, columns: list[str], probs: list[float], by: list[str]) -> DataFrame:
    values = df.select(*by, *[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(columns)])
    cells = [(j, i) for j in range(len(columns)) for i in range(len(probs))]
    ends = [x for p in probs for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketches = values.groupBy(*by).agg(
        *[F.percentile_approx(f"v{j}", ends, ACCURACY).alias(f"s{j}") for j in range(len(columns))],
        *[F.count(f"v{j}").alias(f"n{j}") for j in range(len(columns))],
    )
    sizes = [f"n{j}" for j in range(len(columns))]
    brackets = sketches.select(
        *by,
        *sizes,
        *[F.get(F.col(f"s{j}"), F.lit(2 * i)).alias(f"lo{j}_{i}") for j, i in cells],
        *[F.get(F.col(f"s{j}"), F.lit(2 * i + 1)).alias(f"hi{j}_{i}") for j, i in cells],
    )
    if by:
        brackets = store(brackets, "brackets")  # one row per group
        framed = same_keys(values, brackets.drop(*sizes), by)
    else:
        row = brackets.first()
        framed = values.withColumns({c: F.lit(row[c]).cast("double") for c in brackets.columns if c not in sizes})

    def inside(j: int, i: int) -> Column:
        return F.col(f"v{j}").between(F.col(f"lo{j}_{i}"), F.col(f"hi{j}_{i}"))

    below = framed.groupBy(*by).agg(
        *[F.count_if(F.col(f"v{j}") < F.col(f"lo{j}_{i}")).alias(f"b{j}_{i}") for j, i in cells],
        *[F.count_if(inside(j, i)).alias(f"w{j}_{i}") for j, i in cells],
    )
    keys = [*by, "j", "i"]
    if by:
        facts = [
            F.struct(
                F.lit(j).alias("j"), F.lit(i).alias("i"), ((F.col(f"n{j}") - 1) * F.lit(float(probs[i]))).alias("h"),
                F.col(f"b{j}_{i}").alias("below"), F.col(f"w{j}_{i}").alias("within"),
            )
            for j, i in cells
        ]
        ranks = store(same_keys(brackets, below, by).select(*by, F.explode(F.array(*facts)).alias("r")).select(*by, "r.*").filter("h >= 0"), "ranks")
        outside = (F.floor("h") < F.col("below")) | (F.ceil("h") >= F.col("below") + F.col("within"))
        worst, missed = ranks.agg(F.max("within"), F.max(outside)).first()

        def ranked(rows: DataFrame) -> DataFrame:
            return same_keys(rows, ranks, keys)
    else:
        counts = below.first()
        known = {(j, i): ((row[f"n{j}"] - 1) * probs[i], counts[f"b{j}_{i}"], counts[f"w{j}_{i}"]) for j, i in cells if row[f"n{j}"]}
        worst = max((w for _, _, w in known.values()), default=0)
        missed = any(math.floor(h) < b or math.ceil(h) >= b + w for h, b, w in known.values())

        def ranked(rows: DataFrame) -> DataFrame:
            cell = F.col("j") * len(probs) + F.col("i")
            h, b = (F.create_map(*[F.lit(x) for (j, i), f in known.items() for x in (j * len(probs) + i, f[k])]) for k in (0, 1))
            return rows.withColumns({"h": F.try_element_at(h, cell), "below": F.try_element_at(b, cell)})

    if missed:
        return _by_rank(df, columns, probs, by)
    hits = F.filter(
        F.array(*[F.when(inside(j, i), F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.col(f"v{j}").alias("value"))) for j, i in cells]),
        lambda x: x.isNotNull(),
    )
    near = reduce(Column.__or__, [F.coalesce(inside(j, i), F.lit(False)) for j, i in cells])  # drops nearly all rows before the arrays
    counted = framed.filter(near).select(*by, F.explode(hits).alias("x")).select(*by, "x.*").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    if (worst or 0) <= HOT_ROWS:
        w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("upto", F.sum("n").over(w))
    else:
        placed = running_total(counted, "n", "upto", keys, ["value"])
    upto, n = F.col("below") + F.col("upto"), F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((upto - n <= rank) & (rank < upto), F.col("value")))

    found = ranked(placed).groupBy(*keys).agg(F.max("h").alias("h"), at(F.floor("h")).alias("low"), at(F.ceil("h")).alias("high"))
    out = _as_arrays(found, columns, by)
    return store(out, "quantiles") if by else out


def _by_rank(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Quantiles from the running count over all distinct values."""
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("value")) for j, c in enumerate(columns)])
    values = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*").filter("value IS NOT NULL")
    keys = [*by, "j"]
    counted = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counted, "n", "upto", keys, ["value"])
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("total") - 1) * F.lit(float(p))).alias("h")) for i, p in enumerate(probs)])
    asked = totals.select(*keys, wanted.alias("asked"))

    def holds(rank: Column) -> Column:
        return (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))

    hits = same_keys(placed, asked, keys).withColumn("r", F.explode(F.filter("asked", lambda r: holds(F.floor(r["h"])) | holds(F.ceil(r["h"])))))
    hits = hits.select(*keys, "r.*", "value", "upto", "n")
    found = hits.groupBy(*keys, "i").agg(
        F.max("h").alias("h"),
        F.max(F.when(holds(F.floor("h")), F.col("value"))).alias("low"),
        F.max(F.when(holds(F.ceil("h")), F.col("value"))).alias("high"),
    )
    return _as_arrays(found, columns, by)


def _as_arrays(found: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., j, i, h, low, high) to one array of interpolated values per column."""
    q = found.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h")))
    pairs = F.array_sort(F.collect_list(F.struct("j", "i", "q")))  # columns x probs entries per group
    arrays = q.groupBy(*by).agg(pairs.alias("_all"))

    def column(j: int) -> Column:
        own = F.filter("_all", lambda s: s["j"] == j)
        return F.when(F.size(own) > 0, F.transform(own, lambda s: s["q"]))

    return arrays.select(*by, *[column(j).alias(c) for j, c in enumerate(columns)])
