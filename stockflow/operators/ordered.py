"""Ordered operations (running totals, ranks, rolling windows, forward fill) without hot tasks.

A window function needs all rows of its key in one task, so one key that holds a large share of the
table would stall the job.  Here the rows are range-partitioned by (key, order): a hot key is cut into
as many contiguous segments as it needs.  The segment id is fixed by a reliable checkpoint, because
sampled range bounds may differ when a lost stage is recomputed; windows then run per segment
and a small table with one row per (key, segment) carries state from one segment to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stockflow.session import ensure_checkpoints, store

SEG = "_segment"
HOT_ROWS = 2_000_000  # rows of one key that a single window task may sort
PART_ROWS = 1 << 20  # rows of one partition of a join or window over whole tables

Order = Sequence[str | Column]


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows in the biggest group and in all (one map-side combined aggregate)."""
    if not by:
        return (n := df.count()), n
    found = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return found[0] or 0, found[1] or 0


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the biggest group."""
    return group_sizes(df, by)[0]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, a NULL key being equal to itself; ``right`` adds its other columns."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    twin = right.select(*[F.col(k).alias(f"_twin_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    met = reduce(Column.__and__, [left[k].eqNullSafe(F.col(f"_twin_{i}")) for i, k in enumerate(keys)])
    return left.join(twin, met, how).drop(*[f"_twin_{i}" for i in range(len(keys))])


def segmented(df: DataFrame, by: Sequence[str], order: Order, rows: int | None = None) -> DataFrame:
    """``df`` cut into contiguous (by, order) segments, with a stable segment id column.

    There are as many segments as keep each within ``HOT_ROWS`` rows (``rows``: the table's size, counted if unknown).
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    rows = df.count() if rows is None else rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // HOT_ROWS))
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    return df.repartitionByRange(parts, *keys).withColumn(SEG, F.spark_partition_id()).checkpoint()


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into parts of some ``PART_ROWS`` rows, where the session's shuffles would have larger ones.

    A task's memory then stays the same as the table grows.  Two sides of a join take the ``rows`` of the larger one.
    """
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _join_segments(rows: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join one-row-per-(key, segment) state back to its rows."""
    return same_keys(rows, small, [*by, SEG], "left")


def running_total(df: DataFrame, value: str, out: str, by: Sequence[str], order: Order, rows: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per ``by`` in ``order`` (a total order), for keys of any size."""
    rows = segmented(df, by, order, rows)
    sums = rows.groupBy(*by, SEG).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, SEG, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _join_segments(rows, offsets, by)
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_before", SEG)
    )


def forward_fill(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Order, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Replace NULLs by the last earlier value of the same key (``hot_rows`` as in ``over_entities``)."""
    largest, total = (0, 0) if hot_rows is None else group_sizes(df, by)
    if hot_rows is None or largest <= hot_rows:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    rows = segmented(df, by, order, total)
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    lasts = rows.groupBy(*by, SEG).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_last_{c}") for c in columns]
    )
    before = Window.partitionBy(*by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *by, SEG, *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns]
    )
    inside = Window.partitionBy(*by, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = _join_segments(rows, carried, by)
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")))
    return filled.drop(SEG, *[f"_carry_{c}" for c in columns])


def with_positions(df: DataFrame, out: str, by: Sequence[str], order: Order, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add the 0-based position of a row among those of its key (``hot_rows`` as in ``over_entities``)."""
    if hot_rows is None or largest_group(df, by) <= hot_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    numbered = running_total(df.withColumn("_one", F.lit(1)), "_one", out, by, order).drop("_one")
    return numbered.withColumn(out, (F.col(out) - 1).cast("int"))


def _reached(sizes: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """(by, segment, target, after) of ``sizes`` (by, segment, rows in its tail): the later segments that a segment's tail reaches.

    ``after``, the rows of the tails between, is below ``reach``.  With all tails of a key in a row, targets begin within ``reach`` places
    of a segment's end, so places are cut into stretches of ``reach`` and a segment meets the targets of two of them.
    """
    earlier = Window.partitionBy(*by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    placed = store(sizes.withColumn("_start", F.coalesce(F.sum("_tail").over(earlier), F.lit(0))), "segments")
    stretch = F.floor(F.col("_start") / reach)
    targets = placed.select(*by, F.col(SEG).alias("_target"), F.col("_start").alias("_begin"), stretch.alias("_stretch"))
    ends = placed.select(*by, SEG, (F.col("_start") + F.col("_tail")).alias("_end"))
    ends = ends.withColumn("_stretch", F.explode(F.array(F.floor(F.col("_end") / reach), F.floor(F.col("_end") / reach) + 1)))
    near = same_keys(ends, targets, [*by, "_stretch"]).withColumn("_after", F.col("_begin") - F.col("_end"))
    return near.filter((F.col("_after") >= 0) & (F.col("_after") < reach)).select(*by, SEG, "_target", "_after")


def _halo(rows: DataFrame, by: Sequence[str], order: Order, reach: int) -> DataFrame:
    """Copies of the ``reach`` rows that precede each segment, labelled with that segment.

    Only the last ``reach`` rows of a segment can be within reach of a later one, so the copies are
    made from those tails: at most ``reach`` rows per (key, segment), whatever the key's size and however many segments it has.
    """
    sizes = rows.groupBy(*by, SEG).agg(F.least(F.count(F.lit(1)), F.lit(reach)).alias("_tail"))
    backward = Window.partitionBy(*by, SEG).orderBy(*[c.desc_nulls_last() for c in map(_column, order)])
    tails = rows.withColumn("_from_end", F.row_number().over(backward)).filter(F.col("_from_end") <= reach)
    near = same_keys(tails, _reached(sizes, by, reach), [*by, SEG]).filter(F.col("_after") + F.col("_from_end") <= reach)
    return near.drop(SEG).withColumnRenamed("_target", SEG).select(*rows.columns)


def _column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def over_entities(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Callable[[WindowSpec], dict[str, Column]],
    lookback: int,
    hot_rows: int | None = HOT_ROWS,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back within each key.

    ``hot_rows=None`` states that keys are known to be bounded (one row per calendar period, say).  Otherwise
    the largest key is measured (unless ``sizes``, those of ``group_sizes``, are given), and when it exceeds ``hot_rows`` the table is cut into segments, each
    preceded by a copy of the ``lookback`` rows before it.
    """
    largest, total = (0, 0) if hot_rows is None else sizes or group_sizes(df, by)
    if hot_rows is None or largest <= hot_rows:
        return df.withColumns(columns(Window.partitionBy(*by).orderBy(*order)))
    rows = segmented(df, by, order, total)
    flagged = rows.withColumn("_copy", F.lit(False)).unionByName(_halo(rows, by, order, lookback).withColumn("_copy", F.lit(True)))
    out = flagged.withColumns(columns(Window.partitionBy(*by, SEG).orderBy(*order)))
    return out.filter(~F.col("_copy")).drop("_copy", SEG)
