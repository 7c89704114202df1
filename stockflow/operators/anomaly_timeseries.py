"""Deviation from an entity's own recent history: rolling z-scores and spikes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.scalars import TINY
from stockflow.operators.anomaly_statistical import capped
from stockflow.operators.ordered import HOT_ROWS, largest_group, over_entities, running_total, same_keys, with_positions

WINDOW = 30
SEASON = 7
SPIKE = 3.0


def fit_series(series: DataFrame, value: str = "y", entity: str = "entity_id", order: str = "ds", window: int = WINDOW, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per entity with at least ``window`` points: last rolling mean and deviation, linear trend, size."""
    rows = series.filter(F.col(value).isNotNull())

    def rolling(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(value).over(frame) == window
        return {"_mean": F.when(full, F.avg(value).over(frame)), "_std": F.when(full, F.stddev_samp(value).over(frame))}

    placed = with_positions(over_entities(rows, [entity], [order], rolling, window - 1, hot_rows), "_i", [entity], [order], hot_rows)
    return (
        placed.groupBy(entity)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("_mean", order).alias("rolling_mean"),
            F.max_by("_std", order).alias("rolling_std"),
            F.regr_slope(value, "_i").alias("trend"),
        )
        .filter(F.col("n") >= window)
    )


def seasonal_factors(series: DataFrame, value: str = "y", entity: str = "entity_id", order: str = "ds", period: int = SEASON, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Mean of every ``period``-th value: (entity, position, factor)."""
    placed = with_positions(series.filter(F.col(value).isNotNull()), "_i", [entity], [order], hot_rows)
    placed = placed.withColumn("position", (F.col("_i") % period).cast("int"))
    return placed.groupBy(entity, "position").agg(F.avg(value).alias("factor"))


def _rolling(value: Column, frame) -> tuple[Column, Column]:
    std = F.stddev_samp(value).over(frame)
    return F.avg(value).over(frame), F.when(std == 0, TINY).otherwise(std)


def rolling_scores(
    df: DataFrame, columns: Sequence[str], entity: str = "entity_id", order: Sequence[str] = ("ds",), window: int = WINDOW, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Add per column the trailing rolling z-score ``{c}_rolling_z`` and the spike height ``{c}_height``.

    Entities of more than ``hot_rows`` rows are cut into segments; ``hot_rows=None`` states that there are none (calendar series).
    """

    def make(w):
        frame = w.rowsBetween(-(window - 1), 0)
        out = {}
        for c in columns:
            value = F.col(c).cast("double")
            mean, std = _rolling(value, frame)
            out[f"{c}_rolling_z"] = F.abs(value - mean) / std
            out[f"{c}_height"] = mean + std * SPIKE
        return out

    return over_entities(df, [entity], list(order), make, lookback=window - 1, hot_rows=hot_rows)


def _peaks_segmented(df: DataFrame, value: str, entity: str, order: Sequence[str], out: str, hot_rows: int) -> DataFrame:
    """``peaks`` for entities of any size: runs are numbered by running totals and compared with their neighbours as rows of their own."""
    rows = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    rows = over_entities(rows, [entity], list(order), lambda w: {"_earlier": F.lag("_v").over(w)}, 1, hot_rows)
    rows = rows.withColumns({"_new": F.when(F.col("_earlier").isNull() | (F.col("_earlier") != F.col("_v")), 1).otherwise(0), "_one": F.lit(1)})
    rows = running_total(running_total(rows, "_new", "_run", [entity], order), "_one", "_i", [entity], order)
    runs = rows.groupBy(entity, "_run").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.first("_v").alias("_top"))
    runs = over_entities(runs, [entity], ["_run"], lambda w: {"_left": F.lag("_top").over(w)}, 1, hot_rows).withColumn("_back", -F.col("_run"))
    runs = over_entities(runs, [entity], ["_back"], lambda w: {"_right": F.lag("_top").over(w)}, 1, hot_rows)
    tops = runs.filter("_left < _top AND _right < _top").select(entity, "_run", F.floor((F.col("_lo") + F.col("_hi")) / 2).alias("_middle"))
    flagged = same_keys(rows, tops, [entity, "_run"], "left").withColumn(out, F.coalesce(F.col("_i") == F.col("_middle"), F.lit(False)))
    return flagged.drop("_v", "_earlier", "_new", "_one", "_run", "_i", "_middle")


def peaks(df: DataFrame, value: str = "y", entity: str = "entity_id", order: Sequence[str] = ("ds",), out: str = "is_peak", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Flag local maxima: interior runs of equal values above both neighbours, at the run's middle row.

    Missing values count as 0.  Entities of more than ``hot_rows`` rows are cut into segments; None states that there are none.
    """
    if hot_rows is not None and largest_group(df, [entity]) > hot_rows:
        return _peaks_segmented(df, value, entity, order, out, hot_rows)
    w = Window.partitionBy(entity).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    starts = df.withColumns({"_v": v, "_i": F.row_number().over(w)}).withColumns({"_before": F.lag("_v").over(w), "_after": F.lead("_v").over(w)})
    runs = starts.withColumn("_run", F.sum(F.when(F.col("_v") == F.col("_before"), 0).otherwise(1)).over(so_far))
    run = Window.partitionBy(entity, "_run").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = F.first("_i").over(run), F.last("_i").over(run)
    rises = F.first("_before").over(run) < F.col("_v")
    falls = F.last("_after").over(run) < F.col("_v")
    flagged = runs.withColumn(out, F.coalesce(rises & falls & (F.col("_i") == F.floor((left + right) / 2)), F.lit(False)))
    return flagged.drop("_v", "_i", "_before", "_after", "_run")


def detect_series(
    series: DataFrame, columns: Sequence[str] = ("y",), entity: str = "entity_id", order: Sequence[str] = ("ds",), window: int = WINDOW, spike: float = SPIKE
) -> DataFrame:
    """Add ``is_anomaly`` (rolling deviation or spike in any column) and ``anomaly_score`` (0 to 1)."""
    out = rolling_scores(series, columns, entity, order, window)
    for c in columns:
        out = peaks(out, c, entity, order, f"_{c}_peak")
    flags, scores = F.lit(False), []
    for c in columns:
        z = F.col(f"{c}_rolling_z")
        rolling = F.coalesce(z > spike, F.lit(False))
        high = F.coalesce(F.coalesce(F.col(c), F.lit(0.0)) >= F.col(f"{c}_height"), F.lit(False))
        flags = flags | rolling | (F.col(f"_{c}_peak") & high)
        scores.append(capped(z, spike))
    return out.withColumns({"is_anomaly": flags, "anomaly_score": F.greatest(F.lit(0.0), F.lit(0.0), *scores)}).select(
        *series.columns, "is_anomaly", "anomaly_score"
    )
