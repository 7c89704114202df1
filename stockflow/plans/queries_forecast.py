"""Queries: forecasting models, their accuracy, ensemble and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockflow.operators import forecast as fc
from stockflow.operators.quality import forecast_rules, rule_failures
from stockflow.plans import kpi
from stockflow.plans import views as v
from stockflow.plans.registry import query
from stockflow.plans.views import sql_with
from stockflow.session import materialize

H = 30
Z80, Z95 = "1.2815515655446004::DOUBLE", "1.959963984540054::DOUBLE"
BOUNDS = ["predicted", "lower_80", "upper_80", "lower_95", "upper_95"]

SERIES = f"""s AS (SELECT entity_id, ds, y, row_number() OVER (PARTITION BY entity_id ORDER BY ds) - 1 AS i, row_number() OVER (PARTITION BY entity_id ORDER BY ds DESC) AS age,
           count(*) OVER (PARTITION BY entity_id) AS n, max(ds) OVER (PARTITION BY entity_id) AS last_ds FROM daily),
       steps AS (SELECT unnest(range(1, {H + 1}))::INTEGER AS step)"""

# Holt-Winters with fixed parameters .3 / .1 / .1, one recursion step per position.
HW = """hw AS (
         SELECT a.entity_id, 7::BIGINT AS i, a.y AS level, (b.y - a.y) / 7 AS trend, [1.0::DOUBLE, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0] AS seasonal, 0.0::DOUBLE AS sse, a.n, a.last_ds
         FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.i = 0 AND b.i = 7 WHERE a.n >= 14
         UNION ALL
         SELECT entity_id, i + 1, nl, 0.1::DOUBLE * (nl - level) + (1 - 0.1::DOUBLE) * trend,
                list_concat(list_concat(seasonal[1:(i % 7)], [0.1::DOUBLE * (y / nl) + (1 - 0.1::DOUBLE) * sf]), seasonal[(i % 7) + 2:7]), sse + pow(y - (level + trend) * sf, 2), n, last_ds
         FROM (SELECT *, 0.3::DOUBLE * (y / sf) + (1 - 0.3::DOUBLE) * (level + trend) AS nl
               FROM (SELECT hw.*, s.y, hw.seasonal[(hw.i % 7) + 1] AS sf FROM hw JOIN s ON hw.entity_id = s.entity_id AND hw.i = s.i))),
       state AS (SELECT * FROM hw WHERE i = n)"""

DIFFS = f"""d AS (SELECT entity_id, ds, y, y - lag(y) OVER (PARTITION BY entity_id ORDER BY ds) AS z FROM s),
       l AS (SELECT *, lag(z) OVER (PARTITION BY entity_id ORDER BY ds) AS x FROM d WHERE z IS NOT NULL),
       ar AS (SELECT entity_id, count(*) AS n, max(ds) AS last_ds, regr_intercept(z, x) AS c, regr_slope(z, x) AS phi,
              sqrt(greatest(regr_syy(z, x) - pow(regr_sxy(z, x), 2) / regr_sxx(z, x), 0) / regr_count(z, x)) AS sigma, arg_max(z, ds) AS z, arg_max(y, ds) AS y FROM l GROUP BY 1),
       arp AS (SELECT entity_id, last_ds, c, phi, sigma, 1 AS step, c + phi * z AS dz, y + c + phi * z AS p FROM ar
               UNION ALL SELECT entity_id, last_ds, c, phi, sigma, step + 1, c + phi * dz, p + c + phi * dz FROM arp WHERE step < {H})"""

AR3_NAMES = ["1.0", "x1", "x2", "x3"]


def _det(rows: list[list[str]]) -> str:
    """The determinant of a small matrix of SQL names, by its first column."""
    if len(rows) == 1:
        return rows[0][0]
    parts = [f"{'-' if i % 2 else '+'} {row[0]} * ({_det([r[1:] for r in rows[:i] + rows[i + 1:]])})" for i, row in enumerate(rows)]
    return " ".join(parts)


def _ar3() -> str:
    """CTEs up to ``arp3`` (entity_id, step, p): differences on their three predecessors by the normal equations, forecast step by step."""
    k = range(4)
    m = [[f"m{min(a, b)}{max(a, b)}" for b in k] for a in k]
    sums = ", ".join(f"sum({AR3_NAMES[a]} * {AR3_NAMES[b]}) AS m{a}{b}" for a in k for b in k if a <= b)
    targets = ", ".join(f"sum({AR3_NAMES[a]} * z) AS t{a}" for a in k)
    solved = ", ".join(f"({_det([[f't{a}' if b == c else m[a][b] for b in k] for a in k])}) / det AS b{c}" for c in k)
    left = " - ".join(["yy"] + [f"2 * b{a} * t{a}" for a in k]) + " + " + " + ".join(f"b{a} * b{b} * {m[a][b]}" for a in k for b in k)
    return f"""d3 AS (SELECT *, lag(z, 1) OVER w AS x1, lag(z, 2) OVER w AS x2, lag(z, 3) OVER w AS x3, row_number() OVER (PARTITION BY entity_id ORDER BY ds DESC) AS age
           FROM (SELECT entity_id, ds, y, y - lag(y) OVER (PARTITION BY entity_id ORDER BY ds) AS z FROM s) WHERE z IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY ds)),
       last3 AS (SELECT entity_id, count(*) AS n, max(ds) AS last_ds, arg_max(y, ds) AS y, {", ".join(f"max(z) FILTER (age = {i}) AS r{i}" for i in (1, 2, 3))} FROM d3 GROUP BY 1),
       sums3 AS (SELECT entity_id, count(*) AS m, sum(z * z) AS yy, {sums}, {targets} FROM d3 WHERE x3 IS NOT NULL GROUP BY 1),
       ar3 AS (SELECT *, sqrt(greatest({left}, 0) / m) AS sigma FROM (SELECT *, {solved} FROM (SELECT *, {_det(m)} AS det FROM sums3)) JOIN last3 USING (entity_id) WHERE n > 4),
       arp3 AS (SELECT entity_id, last_ds, b0, b1, b2, b3, sigma, 1 AS step, b0 + b1 * r1 + b2 * r2 + b3 * r3 AS z1, r1 AS z2, r2 AS z3, y + b0 + b1 * r1 + b2 * r2 + b3 * r3 AS p FROM ar3
               UNION ALL SELECT entity_id, last_ds, b0, b1, b2, b3, sigma, step + 1, b0 + b1 * z1 + b2 * z2 + b3 * z3, z1, z2, p + b0 + b1 * z1 + b2 * z2 + b3 * z3
               FROM arp3 WHERE step < {H})"""


WMA = """ma AS (SELECT entity_id, max(last_ds) AS last_ds, sum((least(n, 7) - age + 1) * y) / sum(least(n, 7) - age + 1) AS ma FROM s WHERE age <= 7 GROUP BY 1)"""

MODELS = {
    "hw_f": "SELECT entity_id, step, last_ds + step AS ds, (level + trend * step) * seasonal[((n - 1 + step) % 7) + 1] AS p, abs(level) * 0.1 * sqrt(step) AS sd FROM state, steps",
    "ma_f": "SELECT entity_id, step, last_ds + step AS ds, ma AS p, abs(ma) * 0.1 + 1 AS sd FROM ma, steps",
    "ar_f": "SELECT entity_id, step, last_ds + step AS ds, p, sigma * sqrt(step) AS sd FROM arp",
    "ar3_f": "SELECT entity_id, step, last_ds + step AS ds, p, sigma * sqrt(step) AS sd FROM arp3",
}
PATH = f"SELECT entity_id, step, ds, round(p, 3) AS predicted, round(p - {Z80} * sd, 3) AS lower_80, round(p + {Z80} * sd, 3) AS upper_80, round(p - {Z95} * sd, 3) AS lower_95, round(p + {Z95} * sd, 3) AS upper_95"

MIXED = f"""parts AS (SELECT entity_id, step, ds, p, 0.4::DOUBLE AS w FROM ({MODELS["hw_f"]}) UNION ALL SELECT entity_id, step, ds, p, 0.2::DOUBLE FROM ({MODELS["ma_f"]})
                 UNION ALL SELECT entity_id, step, ds, p, 0.4::DOUBLE FROM ({MODELS["ar3_f"]})),
       mixed AS (SELECT entity_id, step, max(ds) AS ds, sum(p * w) / sum(w) AS p FROM parts GROUP BY 1, 2),
       ens AS (SELECT *, stddev_samp(p) OVER (PARTITION BY entity_id) AS sd FROM mixed)"""
ALL_MODELS = f"WITH {SERIES}, {HW}, {WMA}, {_ar3()}, {MIXED}"


def _rounded(df, digits=3):
    return df.withColumns({c: F.round(c, digits) for c in BOUNDS})


@query(
    "forecast_eval",
    sql_with(
        "daily",
        """WITH p AS (SELECT entity_id, y AS actual, lag(y, 7) OVER (PARTITION BY entity_id ORDER BY ds) AS predicted FROM daily)
        SELECT entity_id, round(avg(abs((actual - predicted) / nullif(actual, 0))) * 100, 2) AS mape, round(avg(abs(actual - predicted)), 2) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 2) AS rmse
        FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1""",
    ),
)
def forecast_eval(spark, d):
    # Accuracy of "the same as seven recorded days ago".
    w = Window.partitionBy("entity_id").orderBy("ds")
    pairs = v.daily(spark, d).select("entity_id", F.col("y").alias("actual"), F.lag("y", 7).over(w).alias("predicted"))
    return fc.evaluate(pairs, by=["entity_id"])


@query("hw_sse", sql_with("daily", f"WITH {SERIES}, {HW} SELECT entity_id, n, round(level, 2) AS level, round(trend, 4) AS trend, round(sqrt(sse / (n - 7)), 2) AS one_step_rmse FROM state", recursive=True))
def hw_sse(spark, d):
    rmse = F.sqrt(F.col("sse") / (F.col("n") - 7))
    return fc.holt_winters_state(v.daily(spark, d)).select("entity_id", "n", F.round("level", 2).alias("level"), F.round("trend", 4).alias("trend"), F.round(rmse, 2).alias("one_step_rmse"))


@query("hw_fit")
def hw_fit(spark, d):
    return fc.fit_holt_winters(v.daily(spark, d))


@query(
    "forecast_hw_compat",
    sql_with(
        "daily",
        f"""WITH {SERIES}, b AS (SELECT entity_id, max(last_ds) AS last_ds, max(y) FILTER (i = 0) AS y0, max(y) FILTER (i = 7) AS y7 FROM s WHERE n >= 14 GROUP BY 1),
        f AS (SELECT entity_id, step, last_ds + step AS ds, y0 + (y7 - y0) / 7 * step AS p, abs(y0) * 0.1 * sqrt(step) AS sd FROM b, steps) {PATH} FROM f""",
    ),
)
def forecast_hw_compat(spark, d):
    return _rounded(fc.forecast_holt_winters(v.daily(spark, d), H, compat=True))


@query("forecast_hw", sql_with("daily", f"WITH {SERIES}, {HW}, f AS ({MODELS['hw_f']}) {PATH} FROM f", recursive=True))
def forecast_hw(spark, d):
    return _rounded(fc.forecast_holt_winters(v.daily(spark, d), H))


@query("forecast_ma", sql_with("daily", f"WITH {SERIES}, ma AS (SELECT entity_id, max(last_ds) AS last_ds, avg(y) AS ma FROM s WHERE age <= 7 GROUP BY 1), f AS ({MODELS['ma_f']}) {PATH} FROM f"))
def forecast_ma(spark, d):
    return _rounded(fc.forecast_moving_average(v.daily(spark, d), H, weighted=False))


@query("forecast_wma", sql_with("daily", f"WITH {SERIES}, {WMA}, f AS ({MODELS['ma_f']}) {PATH} FROM f"))
def forecast_wma(spark, d):
    return _rounded(fc.forecast_moving_average(v.daily(spark, d), H))


@query("ar_fit", sql_with("daily", f"WITH {SERIES}, {DIFFS} SELECT entity_id, n, last_ds, round(c, 4) AS intercept, round(phi, 6) AS phi, round(sigma, 3) AS sigma FROM ar", recursive=True))
def ar_fit(spark, d):
    out = fc.fit_ar1(v.daily(spark, d))
    return out.select("entity_id", "n", "last_ds", F.round(F.get("coefficients", F.lit(0)), 4).alias("intercept"), F.round(F.get("coefficients", F.lit(1)), 6).alias("phi"), F.round("sigma", 3).alias("sigma"))


@query("forecast_ar1", sql_with("daily", f"WITH {SERIES}, {DIFFS}, f AS ({MODELS['ar_f']}) {PATH} FROM f", recursive=True))
def forecast_ar1(spark, d):
    return _rounded(fc.forecast_autoregression(v.daily(spark, d), H, p=1))


@query("forecast_ar", sql_with("daily", f"WITH {SERIES}, {_ar3()}, f AS ({MODELS['ar3_f']}) {PATH} FROM f", recursive=True))
def forecast_ar(spark, d):
    return _rounded(fc.forecast_autoregression(v.daily(spark, d), H))


def _series(spark, d):
    """The daily series, written once: every model reads it."""
    return materialize(v.daily(spark, d), "daily")


def _mixed(series):
    return fc.forecast_ensemble(series, H)


@query("forecast_ensemble", sql_with("daily", f"{ALL_MODELS} {PATH} FROM ens", recursive=True))
def forecast_ensemble(spark, d):
    return _rounded(_mixed(_series(spark, d)))


@query("forecast_ensemble_fitted")
def forecast_ensemble_fitted(spark, d):
    return fc.forecast_ensemble(_series(spark, d), H, params=None)


def _acf(alias: str, lags=range(1, 8)) -> str:
    lagged = ", ".join(f"lag(y, {k}) OVER (PARTITION BY entity_id ORDER BY ds) AS l{k}" for k in lags)
    rows = " UNION ALL ".join(f"SELECT entity_id, count(*) AS n, {k} AS lag, corr(y, l{k}) AS acf FROM lagged GROUP BY 1" for k in lags)
    return f"lagged AS (SELECT entity_id, y, {lagged} FROM daily), {alias} AS ({rows})"


@query("acf", sql_with("daily", f"WITH {_acf('a')} SELECT entity_id, n, lag, round(acf, 6) AS acf FROM a WHERE lag < n // 2"))
def acf(spark, d):
    return fc.autocorrelation(v.daily(spark, d)).withColumn("acf", F.round("acf", 6))


RECORDS = f"""{ALL_MODELS}, {_acf("a")},
    dir AS (SELECT entity_id, CASE WHEN regr_slope(p, step) > abs(avg(p)) * 0.01 THEN 'increasing' WHEN regr_slope(p, step) < -abs(avg(p)) * 0.01 THEN 'decreasing' ELSE 'stable' END AS trend_direction FROM ens GROUP BY 1),
    strength AS (SELECT entity_id, max(abs(acf)) AS seasonality_strength FROM a WHERE n >= 14 AND lag < n // 2 GROUP BY 1)"""


def _records(series):
    return fc.forecast_records(series, _mixed(series), "revenue")


@query(
    "forecast_records",
    sql_with(
        "daily",
        f"""{RECORDS} SELECT 'revenue' AS metric_name, entity_id, ds AS forecast_date, round(p, 3) AS predicted_value, round(p - {Z80} * sd, 3) AS lower_bound_80, round(p + {Z80} * sd, 3) AS upper_bound_80,
            round(p - {Z95} * sd, 3) AS lower_bound_95, round(p + {Z95} * sd, 3) AS upper_bound_95, trend_direction, round(coalesce(seasonality_strength, 0), 6) AS seasonality_strength
            FROM ens JOIN dir USING (entity_id) LEFT JOIN strength USING (entity_id)""",
        recursive=True,
    ),
)
def forecast_records(spark, d):
    bounds = ["predicted_value", "lower_bound_80", "upper_bound_80", "lower_bound_95", "upper_bound_95"]
    return _records(_series(spark, d)).withColumns({**{c: F.round(c, 3) for c in bounds}, "seasonality_strength": F.round("seasonality_strength", 6)})


@query("forecast_records_default")
def forecast_records_default(spark, d):
    """Records of the default models and horizon (fitted smoothing, AR(3), 30 steps); without SQL, as the fit is a search."""
    series = _series(spark, d)
    return fc.forecast_records(series, fc.forecast_ensemble(series, params=None), "revenue")


@query(
    "forecast_valid",
    sql_with(
        "daily",
        f"""{RECORDS}, r AS (SELECT p, p - {Z80} * sd AS l8, p + {Z80} * sd AS u8, p - {Z95} * sd AS l9, p + {Z95} * sd AS u9, coalesce(seasonality_strength, 0) AS ss FROM ens LEFT JOIN strength USING (entity_id))
        SELECT 'lower_95_outside' AS rule, count(*) FILTER (l9 > l8) AS failed_records FROM r UNION ALL SELECT 'upper_95_outside', count(*) FILTER (u9 < u8) FROM r
        UNION ALL SELECT 'inside_80', count(*) FILTER (NOT p BETWEEN l8 AND u8) FROM r UNION ALL SELECT 'seasonality_range', count(*) FILTER (NOT ss BETWEEN 0 AND 1) FROM r""",
        recursive=True,
    ),
)
def forecast_valid(spark, d):
    return rule_failures(_records(_series(spark, d)), forecast_rules())


@query(
    "forecast_view",
    sql_with(
        "daily",
        f"""{ALL_MODELS} SELECT entity_id, 'history' AS kind, ds, y AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM daily
            UNION ALL SELECT entity_id, 'forecast', ds, round(p, 3), round(p - {Z95} * sd, 3), round(p + {Z95} * sd, 3) FROM ens""",
        recursive=True,
    ),
)
def forecast_view(spark, d):
    series = _series(spark, d)
    out = kpi.forecast_view(series, _records(series))
    rounded = {c: F.when(F.col("kind") == "forecast", F.round(c, 3)).otherwise(F.col(c)) for c in ("value", "lower", "upper")}
    return out.withColumns(rounded)
