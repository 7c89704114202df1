"""Deviation from fitted column statistics: z-score, modified z-score, quartile fences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import TINY, numeric_columns
from stockflow.operators.ordered import largest_group, same_keys
from stockflow.operators.quantiles import exact_quantiles

STATS = ("mean", "std", "median", "mad", "q1", "q3")


@dataclass
class StatModel:
    """Fitted statistics: one row per entity (or one row in all) with ``{column}_{stat}`` columns."""

    frame: DataFrame
    columns: list[str]
    by: list[str]
    values: dict[str, float] | None = None  # the single row of a global model

    def attach(self, df: DataFrame) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
        """``df`` with its statistics within reach, and for each column the expressions that give them."""
        columns = [c for c in self.columns if c in df.columns]
        if self.by:
            names = {c: {s: f"_fit_{c}_{s}" for s in STATS} for c in columns}
            model = self.frame.select(*self.by, *[F.col(f"{c}_{s}").alias(n) for c, m in names.items() for s, n in m.items()])
            return same_keys(df, model, self.by, "left"), {c: {s: F.col(n) for s, n in m.items()} for c, m in names.items()}
        row = self.values or self.frame.first().asDict()
        return df, {c: {s: F.lit(row[f"{c}_{s}"]).cast("double") for s in STATS} for c in columns}

    def long(self) -> DataFrame:
        """(entity..., metric, mean, std, median, mad, q1, q3)."""
        rows = F.array(*[F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}_{s}").alias(s) for s in STATS]) for c in self.columns])
        return self.frame.select(*self.by, F.explode(rows).alias("m")).select(*self.by, "m.*")


def fit_statistics(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> StatModel:
    """Mean, sample deviation, median, MAD and quartiles of the non-null values per column (and entity).

    ``df`` is scanned several times: pass a materialised frame when it is expensive to compute.
    """
    columns = [c for c in (numeric_columns(df) if columns is None else columns) if c not in by]
    by = list(by)
    moments = df.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])
    largest = largest_group(df, by)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by, rows=largest).select(
        *by, *[F.get(F.col(c), F.lit(i)).alias(f"{c}_{s}") for c in columns for i, s in enumerate(("q1", "median", "q3"))]
    )
    if by:
        centred = same_keys(df, quartiles.select(*by, *[f"{c}_median" for c in columns]), by)
        medians = {c: F.col(f"{c}_median") for c in columns}
        spread = centred.select(*by, *[F.abs(F.col(c) - medians[c]).alias(c) for c in columns])
        mads = exact_quantiles(spread, columns, [0.5], by, rows=largest).select(*by, *[F.get(F.col(c), F.lit(0)).alias(f"{c}_mad") for c in columns])
        frame = same_keys(same_keys(moments, quartiles, by), mads, by)
    else:
        found = {**moments.first().asDict(), **quartiles.first().asDict()}  # a few numbers per column
        spread = df.select(*[F.abs(F.col(c) - F.lit(found[f"{c}_median"])).cast("double").alias(c) for c in columns])
        mads = exact_quantiles(spread, columns, [0.5], rows=largest).first()
        found.update({f"{c}_mad": mads[c][0] if mads[c] else None for c in columns})
        schema = ", ".join(f"`{c}_{s}` double" for c in columns for s in STATS)
        values = {f"{c}_{s}": None if found[f"{c}_{s}"] is None else float(found[f"{c}_{s}"]) for c in columns for s in STATS}
        return StatModel(df.sparkSession.createDataFrame([tuple(values.values())], schema), columns, by, values)
    return StatModel(frame, columns, by)


def _floor(spread: Column) -> Column:
    return F.when(spread == 0, TINY).otherwise(spread)


def zscore(value: Column, stats: dict[str, Column]) -> Column:
    return F.abs(value - stats["mean"]) / _floor(stats["std"])


def modified_zscore(value: Column, stats: dict[str, Column]) -> Column:
    return F.abs(value - stats["median"]) * 0.6745 / _floor(stats["mad"])


def column_flag(method: str, value: Column, stats: dict[str, Column], threshold: float) -> Column:
    if method == "zscore":
        hit = zscore(value, stats) > threshold
    elif method == "modified_zscore":
        hit = modified_zscore(value, stats) > threshold
    elif method == "iqr":
        reach = (stats["q3"] - stats["q1"]) * 1.5
        hit = (value < stats["q1"] - reach) | (value > stats["q3"] + reach)
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def capped(z: Column, threshold: float) -> Column:
    """Score 0 to 1: twice the threshold or more is 1, a missing z-score is 0."""
    return F.when(z.isNotNull(), F.least(z / (2 * threshold), F.lit(1.0))).otherwise(0.0)


def column_score(value: Column, stats: dict[str, Column], threshold: float) -> Column:
    return capped(modified_zscore(value, stats), threshold)


def _any(flags: Sequence[Column]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def _highest(scores: Sequence[Column]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(0.0), *scores)


def detect(df: DataFrame, model: StatModel, method: str = "modified_zscore", threshold: float = 3.0, flag: str = "is_anomaly", score: str = "anomaly_score") -> DataFrame:
    """Add a flag (any column out of bounds) and a score from 0 to 1 (the most deviating column).

    Columns that were not fitted are ignored.  No shuffle for a global model; per-entity models are
    joined on the entity, and the size of the model decides how.
    """
    rows, stats = model.attach(df)
    out = rows.withColumns(
        {
            flag: _any([column_flag(method, F.col(c), s, threshold) for c, s in stats.items()]),
            score: _highest([column_score(F.col(c), s, threshold) for c, s in stats.items()]),
        }
    )
    return out.select(*df.columns, flag, score)
