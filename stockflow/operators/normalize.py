"""Scaling of numeric columns: min-max, z-score, robust."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import numeric_columns
from stockflow.operators.quantiles import exact_quantiles


def _centre_and_scale(df: DataFrame, columns: Sequence[str], method: str, by: Sequence[str]) -> DataFrame:
    """One row per group with ``_c_{column}`` and ``_s_{column}``."""
    if method == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by)
        parts = [
            part
            for c in columns
            for part in (F.get(F.col(c), F.lit(1)).alias(f"_c_{c}"), (F.get(F.col(c), F.lit(2)) - F.get(F.col(c), F.lit(0))).alias(f"_s_{c}"))
        ]
        return q.select(*by, *parts)
    centre, scale = {
        "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        "zscore": (F.avg, F.stddev_samp),
    }[method]
    return df.groupBy(*by).agg(*[x for c in columns for x in (centre(c).alias(f"_c_{c}"), scale(c).alias(f"_s_{c}"))])


def normalize(df: DataFrame, columns: Sequence[str] | None = None, method: str = "minmax", by: Sequence[str] = ()) -> DataFrame:
    """Add ``{column}_normalized`` for each known column (default: all numeric ones).

    A column without spread gets NULLs, so the schema does not depend on the data.
    """
    chosen = [c for c in (numeric_columns(df) if columns is None else columns) if c in df.columns]
    if not chosen:
        return df
    stats = _centre_and_scale(df, chosen, method, by)

    def scaled(c: str, centre: Column, scale: Column) -> Column:
        return F.when(scale > 0, (F.col(c) - centre) / scale).cast("double")

    if by:
        joined = df.join(stats, list(by), "left")
        out = joined.withColumns({f"{c}_normalized": scaled(c, F.col(f"_c_{c}"), F.col(f"_s_{c}")) for c in chosen})
        return out.drop(*[f"{p}{c}" for c in chosen for p in ("_c_", "_s_")])
    row = stats.first()  # a handful of numbers
    return df.withColumns({f"{c}_normalized": scaled(c, F.lit(row[f"_c_{c}"]), F.lit(row[f"_s_{c}"])) for c in chosen})
