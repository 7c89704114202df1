"""Per-entity forecasts: Holt-Winters, moving average, autoregression, weighted ensemble.

Input is a period series (entity_id, ds, y): one row per entity and calendar period, so one entity's
history is bounded by the calendar and fits a task; the work is parallel over entities.  Forecast rows are
(entity_id, step, ds, predicted, lower_80, upper_80, lower_95, upper_95), dated from the last observation.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.scalars import Z80, Z95, correlation, ratio
from stockflow.operators.protocols import Forecaster

SEASON = 7
HORIZON = 30
START = (0.3, 0.1, 0.1)  # alpha, beta, gamma
LOW, HIGH = 0.01, 0.99
# Ensemble weights, and the weight of a model that is not listed.
WEIGHTS = {"exp_smoothing": 0.4, "moving_average": 0.2, "arima": 0.4}
OTHER_WEIGHT = 0.3


def clean(series: DataFrame) -> DataFrame:
    return series.select("entity_id", "ds", F.col("y").cast("double").alias("y")).filter("y IS NOT NULL")


def _arrays(series: DataFrame) -> DataFrame:
    """(entity_id, ys, n, last_ds): the sorted values of each entity's periods."""
    pairs = F.array_sort(F.collect_list(F.struct("ds", "y")))
    return clean(series).groupBy("entity_id").agg(
        F.transform(pairs, lambda s: s["y"]).alias("ys"), F.count(F.lit(1)).cast("int").alias("n"), F.max("ds").alias("last_ds")
    )


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.date_add("last_ds", F.col("step")))


def _with_bounds(df: DataFrame, predicted: Column, spread: Column) -> DataFrame:
    out = df.withColumns({"predicted": predicted, "_s": spread})
    p, s = F.col("predicted"), F.col("_s")
    return out.select(
        "entity_id",
        "step",
        "ds",
        "predicted",
        (p - Z80 * s).alias("lower_80"),
        (p + Z80 * s).alias("upper_80"),
        (p - Z95 * s).alias("lower_95"),
        (p + Z95 * s).alias("upper_95"),
    )


# ---------------------------------------------------------------- Holt-Winters


def _element(array: str | Column, i: Column) -> Column:
    return F.get(F.col(array) if isinstance(array, str) else array, i)


def _smooth(ys: str, n: str, alpha: Column, beta: Column, gamma: Column, m: int) -> Column:
    """Final state of the multiplicative recursion over one entity's sorted values."""
    y0 = _element(ys, F.lit(0))
    start = F.struct(
        y0.alias("level"),
        ((_element(ys, F.lit(m)) - y0) / m).alias("trend"),
        F.array_repeat(F.lit(1.0), m).alias("seasonal"),
        F.lit(0.0).alias("sse"),
    )

    def step(s, i):
        y, k = _element(ys, i), i % m
        base, season = s["level"] + s["trend"], _element(s["seasonal"], k)
        level = alpha * F.coalesce(ratio(y, season), base) + (1 - alpha) * base
        trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        factor = F.coalesce(gamma * ratio(y, level) + (1 - gamma) * season, season)
        return F.struct(
            level.alias("level"),
            trend.alias("trend"),
            F.transform(s["seasonal"], lambda v, j: F.when(j == k, factor).otherwise(v)).alias("seasonal"),
            (s["sse"] + F.pow(y - base * season, F.lit(2.0))).alias("sse"),
        )

    return F.aggregate(F.sequence(F.lit(m), F.col(n) - 1), start, step)


def holt_winters_state(series: DataFrame, params: DataFrame | Sequence[float] = START, season: int = SEASON) -> DataFrame:
    """(entity_id, n, last_ds, alpha, beta, gamma, level, trend, seasonal, sse); none below two seasons.

    ``params`` is one triple for all entities or a frame (entity_id, alpha, beta, gamma).
    """
    rows = _arrays(series).filter(F.col("n") >= 2 * season)
    if isinstance(params, DataFrame):
        rows = rows.join(params.select("entity_id", "alpha", "beta", "gamma"), "entity_id")
    else:
        rows = rows.withColumns({name: F.lit(float(v)) for name, v in zip(("alpha", "beta", "gamma"), params)})
    state = _smooth("ys", "n", F.col("alpha"), F.col("beta"), F.col("gamma"), season)
    return rows.withColumn("_s", state).select(
        "entity_id", F.col("n").cast("bigint").alias("n"), "last_ds", "alpha", "beta", "gamma", "_s.level", "_s.trend", "_s.seasonal", "_s.sse"
    )


def _sse(y: np.ndarray, grid: np.ndarray, m: int) -> np.ndarray:
    """Squared one-step error of many parameter triples at once."""
    a, b, g = grid.T
    level = np.full(len(grid), y[0])
    trend = np.full(len(grid), (y[m] - y[0]) / m)
    seasonal = np.ones((m, len(grid)))
    error = np.zeros(len(grid))
    with np.errstate(all="ignore"):
        for i in range(m, len(y)):
            base, season = level + trend, seasonal[i % m]
            error += (y[i] - base * season) ** 2
            new = a * np.where(season == 0, base, y[i] / season) + (1 - a) * base
            trend = b * (new - level) + (1 - b) * trend
            seasonal[i % m] = np.where(new == 0, season, g * (y[i] / new) + (1 - g) * season)
            level = new
    return np.where(np.isfinite(error), error, np.inf)


def _search(y: np.ndarray, m: int, rounds: int = 8) -> tuple[float, float, float, float]:
    """Grid search over (alpha, beta, gamma), narrowed around the best triple round by round."""
    best, width = np.array(START), (HIGH - LOW) / 2
    axes = [np.linspace(LOW, HIGH, 7)] * 3
    score = np.inf
    for _ in range(rounds):
        grid = np.vstack([best, np.array(list(itertools.product(*axes)))])
        errors = _sse(y, grid, m)
        i = int(np.argmin(errors))
        best, score = grid[i], float(errors[i])
        width /= 2.5
        axes = [np.unique(np.clip(np.linspace(v - width, v + width, 5), LOW, HIGH)) for v in best]
    return float(best[0]), float(best[1]), float(best[2]), score


def fit_holt_winters(series: DataFrame, season: int = SEASON) -> DataFrame:
    """Best (alpha, beta, gamma) per entity by one-step squared error: (entity_id, alpha, beta, gamma, sse)."""
    rows = clean(series)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2 * season:
            return pd.DataFrame(columns=["entity_id", "alpha", "beta", "gamma", "sse"])
        a, b, g, sse = _search(pdf.sort_values("ds")["y"].to_numpy(), season)
        return pd.DataFrame({"entity_id": [pdf["entity_id"].iloc[0]], "alpha": [a], "beta": [b], "gamma": [g], "sse": [sse]})

    kind = series.schema["entity_id"].dataType.simpleString()
    return rows.groupBy("entity_id").applyInPandas(one, f"entity_id {kind}, alpha double, beta double, gamma double, sse double")


def forecast_holt_winters(
    series: DataFrame, horizon: int = HORIZON, params: DataFrame | Sequence[float] | None = START, season: int = SEASON, compat: bool = False
) -> DataFrame:
    """Forecast from the final smoothed state; ``params=None`` fits them first.

    ``compat`` extends the straight line of the first season instead.
    """
    if compat:
        rows = _arrays(series).filter(F.col("n") >= 2 * season)
        y0 = _element("ys", F.lit(0))
        rows = rows.withColumns({"level": y0, "trend": (_element("ys", F.lit(season)) - y0) / season})
        predicted = F.col("level") + F.col("trend") * F.col("step")
    else:
        rows = holt_winters_state(series, fit_holt_winters(series, season) if params is None else params, season)
        position = ((F.col("n") - 1 + F.col("step")) % season).cast("int")
        predicted = (F.col("level") + F.col("trend") * F.col("step")) * _element("seasonal", position)
    return _with_bounds(_steps(rows, horizon), predicted, F.abs("level") * 0.1 * F.sqrt(F.col("step").cast("double")))


# ---------------------------------------------------------------- moving average


def moving_average(series: DataFrame, window: int = SEASON, weighted: bool = True, compat: bool = False) -> DataFrame:
    """(entity_id, last_ds, ma): mean of the last values, the newest heaviest (``compat``: the oldest)."""
    newest = Window.partitionBy("entity_id").orderBy(F.col("ds").desc())
    last = clean(series).withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= window)
    sized = last.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("entity_id")))
    weight = F.lit(1.0)
    if weighted:
        weight = (F.col("age") if compat else F.col("k") - F.col("age") + 1).cast("double")
    return sized.withColumn("w", weight).groupBy("entity_id").agg(
        F.max("ds").alias("last_ds"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("ma")
    )


def forecast_moving_average(series: DataFrame, horizon: int = HORIZON, window: int = SEASON, weighted: bool = True, compat: bool = False) -> DataFrame:
    rows = moving_average(series, window, weighted, compat)
    return _with_bounds(_steps(rows, horizon), F.col("ma"), F.abs("ma") * 0.1 + 1)


# ---------------------------------------------------------------- autoregression


def _differences(series: DataFrame, d: int) -> DataFrame:
    """``d``-fold differences as ``z``, keeping the value of every lower order as ``_y0`` .. ``_y{d-1}``."""
    w = Window.partitionBy("entity_id").orderBy("ds")
    out = clean(series).withColumn("z", F.col("y"))
    for order in range(d):
        out = out.withColumn(f"_y{order}", F.col("z")).withColumn("z", F.col("z") - F.lag("z").over(w))
    return out


FIT = T.StructType([T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType())])


@F.pandas_udf(FIT)
def _solve(products: pd.Series, targets: pd.Series, square: pd.Series, rows: pd.Series) -> pd.DataFrame:
    """Least squares from the sums of products of one entity per row."""
    out = []
    for xx, xy, yy, m in zip(products, targets, square, rows):
        xy = np.array(xy, dtype=float)
        matrix = np.array(xx, dtype=float).reshape(len(xy), len(xy))
        # The intercept's and the lags' sums differ by many powers of ten: on one scale no digits are lost.
        scale = np.sqrt(np.where(np.diag(matrix) > 0, np.diag(matrix), 1.0))
        b = np.linalg.lstsq(matrix / np.outer(scale, scale), xy / scale, rcond=None)[0] / scale
        rss = max(float(yy - 2 * b @ xy + b @ matrix @ b), 0.0)
        out.append((b.tolist(), float(np.sqrt(rss / m))))
    return pd.DataFrame(out, columns=["coefficients", "sigma"])


def fit_autoregression(series: DataFrame, p: int = 3, d: int = 1, q: int = 1) -> DataFrame:
    """(entity_id, n, last_ds, coefficients, sigma, recent, lasts): OLS of differences on an intercept and p lags.

    ``q`` only sets the minimum length (more than p + q differences); no error terms are fitted.
    """
    w = Window.partitionBy("entity_id").orderBy("ds")
    diffs = _differences(series, d)
    present = diffs.filter("z IS NOT NULL")
    names = ["_one", *[f"_x{i}" for i in range(1, p + 1)]]
    lagged = present.withColumns({"_one": F.lit(1.0), **{f"_x{i}": F.lag("z", i).over(w) for i in range(1, p + 1)}})
    complete = F.col(names[-1]).isNotNull()

    def total(expression: Column) -> Column:
        return F.sum(F.when(complete, expression))

    age = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("ds").desc()))
    fits = (
        lagged.withColumn("_age", age)
        .groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("ds").alias("last_ds"),
            F.array(*[total(F.col(a) * F.col(b)) for a in names for b in names]).alias("xx"),
            F.array(*[total(F.col(a) * F.col("z")) for a in names]).alias("xy"),
            total(F.col("z") * F.col("z")).alias("yy"),
            F.count_if(complete).alias("m"),
            F.array(*[F.max(F.when(F.col("_age") == i, F.col("z"))) for i in range(1, p + 1)]).alias("recent"),
            F.array(*[F.max_by(f"_y{o}", "ds") for o in range(d)]).cast("array<double>").alias("lasts"),
        )
        .filter(F.col("n") > p + q)
    )
    return fits.withColumn("_f", _solve("xx", "xy", "yy", "m")).select("entity_id", "n", "last_ds", "_f.coefficients", "_f.sigma", "recent", "lasts")


def fit_ar1(series: DataFrame) -> DataFrame:
    """AR(1) on first differences with built-in regression aggregates only; same columns as the general fit."""
    w = Window.partitionBy("entity_id").orderBy("ds")
    diffs = _differences(series, 1).filter("z IS NOT NULL").withColumn("x", F.lag("z").over(w))
    z, x = F.col("z"), F.col("x")
    slope = F.regr_slope(z, x)
    rss = F.greatest(F.regr_syy(z, x) - F.pow(F.regr_sxy(z, x), F.lit(2.0)) / F.regr_sxx(z, x), F.lit(0.0))
    return diffs.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("ds").alias("last_ds"),
        F.array(F.regr_intercept(z, x), slope).alias("coefficients"),
        F.sqrt(rss / F.regr_count(z, x)).alias("sigma"),
        F.array(F.max_by("z", "ds")).alias("recent"),
        F.array(F.max_by("_y0", "ds")).alias("lasts"),
    ).filter("n > 2")


def _no_values() -> Column:
    return F.array().cast("array<double>")


def _cumulated(path: str, first: Column) -> Column:
    """Running sum of an array, on top of ``first``."""
    return F.aggregate(path, _no_values(), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), first) + v)))


def forecast_autoregression(series: DataFrame, horizon: int = HORIZON, p: int = 3, d: int = 1, q: int = 1, compat: bool = False) -> DataFrame:
    """Recursive forecast of the differences, summed back to levels (``compat``: left as differences)."""
    fits = fit_ar1(series) if (p, d) == (1, 1) else fit_autoregression(series, p, d, q)

    def advance(s, _):
        terms = [_element("coefficients", F.lit(i + 1)) * _element(s["recent"], F.lit(i)) for i in range(p)]
        value = _element("coefficients", F.lit(0))
        for term in terms:
            value = value + term
        return F.struct(
            F.slice(F.concat(F.array(value), s["recent"]), 1, p).alias("recent"), F.concat(s["path"], F.array(value)).alias("path")
        )

    start = F.struct(F.col("recent").alias("recent"), _no_values().alias("path"))
    paths = fits.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda s: s["path"]))
    for order in reversed(range(0 if compat else d)):
        last = _element("lasts", F.lit(order))
        paths = paths.withColumn("path", _cumulated("path", last))
    rows = _steps(paths, horizon)
    return _with_bounds(rows, _element("path", F.col("step") - 1), F.col("sigma") * F.sqrt(F.col("step").cast("double")))


# ---------------------------------------------------------------- ensemble


def ensemble(models: dict[str, DataFrame]) -> DataFrame:
    """Weighted mean of the models that produced a forecast, with bounds from the spread of the path."""
    parts = None
    for name, frame in models.items():
        weight = WEIGHTS.get(name, OTHER_WEIGHT)
        part = frame.select("entity_id", "step", "ds", (F.col("predicted") * weight).alias("wp"), F.lit(weight).alias("w"))
        parts = part if parts is None else parts.unionByName(part)
    mixed = parts.groupBy("entity_id", "step").agg(F.max("ds").alias("ds"), (F.sum("wp") / F.sum("w")).alias("p"))
    whole = Window.partitionBy("entity_id")
    spread = F.coalesce(F.stddev_samp("p").over(whole), F.abs("p") * 0.1)
    return _with_bounds(mixed.withColumn("_spread", spread), F.col("p"), F.col("_spread"))


def user_ensemble(series: DataFrame, forecasters: dict[str, Forecaster], horizon: int = HORIZON) -> DataFrame:
    """``ensemble`` of any forecasters; names of the standard models carry their weights."""
    return ensemble({name: forecaster.forecast(series, horizon) for name, forecaster in forecasters.items()})


def forecast_ensemble(series: DataFrame, horizon: int = HORIZON, params: DataFrame | Sequence[float] | None = START, p: int = 3) -> DataFrame:
    return ensemble(
        {
            "exp_smoothing": forecast_holt_winters(series, horizon, params),
            "moving_average": forecast_moving_average(series, horizon),
            "arima": forecast_autoregression(series, horizon, p),
        }
    )


def autocorrelation(series: DataFrame, max_lag: int = 7) -> DataFrame:
    """(entity_id, lag, acf) for lags below half the series' length."""
    w = Window.partitionBy("entity_id").orderBy("ds")
    lags = range(1, max_lag + 1)
    lagged = clean(series).withColumns({f"_l{k}": F.lag("y", k).over(w) for k in lags})
    wide = lagged.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), *[correlation(F.col("y"), F.col(f"_l{k}")).alias(f"a{k}") for k in lags]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("acf")) for k in lags])
    return wide.select("entity_id", "n", F.explode(rows).alias("r")).filter(F.col("r.lag") < F.floor(F.col("n") / 2)).select("entity_id", "n", "r.lag", "r.acf")


def forecast_records(series: DataFrame, forecast: DataFrame, metric: str) -> DataFrame:
    """One record per entity and step: bounds, direction of the path, strength of the weekly pattern."""
    mean, slope = F.avg("predicted"), F.regr_slope("predicted", "step")
    limit = F.abs(mean) * 0.01
    paths = forecast.groupBy("entity_id").agg(
        F.when(slope > limit, "increasing").when(slope < -limit, "decreasing").otherwise("stable").alias("trend_direction")
    )
    pattern = autocorrelation(series).filter("n >= 14").groupBy("entity_id").agg(F.max(F.abs("acf")).alias("_s"))
    return (
        forecast.join(paths, "entity_id")
        .join(pattern, "entity_id", "left")
        .select(
            F.lit(metric).alias("metric_name"),
            F.col("entity_id").cast("string").alias("entity_id"),
            F.col("ds").alias("forecast_date"),
            F.col("predicted").alias("predicted_value"),
            F.col("lower_80").alias("lower_bound_80"),
            F.col("upper_80").alias("upper_bound_80"),
            F.col("lower_95").alias("lower_bound_95"),
            F.col("upper_95").alias("upper_bound_95"),
            "trend_direction",
            F.coalesce("_s", F.lit(0.0)).alias("seasonality_strength"),
        )
    )


def evaluate(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """MAPE (zero actuals left out), MAE and RMSE over complete pairs."""
    a, p = F.col(actual), F.col(predicted)
    error = a - p
    return (
        pairs.filter(a.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.round(F.avg(F.abs(ratio(error, a))) * 100, 2).alias("mape"),
            F.round(F.avg(F.abs(error)), 2).alias("mae"),
            F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
        )
    )
