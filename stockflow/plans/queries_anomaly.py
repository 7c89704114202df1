"""Queries: statistical, time-series and machine-learned anomaly detection, ensemble, records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stockflow.operators import anomaly_ensemble as ens
from stockflow.operators import anomaly_ml as ml
from stockflow.operators import anomaly_statistical as stat
from stockflow.operators import anomaly_timeseries as ts
from stockflow.operators.quality import anomaly_rules, rule_failures
from stockflow.plans import kpi, sql_models
from stockflow.plans import views as v
from stockflow.plans.registry import query
from stockflow.plans.views import sql_with
from stockflow.session import materialize, scratch_path, widen
from stockflow.streaming import jobs

METRICS = ["quantity", "unit_price", "total_amount"]
STOCK = ["quantity_on_hand", "quantity_allocated", "quantity_in_transit"]


def _lines(spark, d):
    return widen(v.sales(spark, d, "l_orderkey", "l_linenumber", *METRICS))


def _fit_sql(columns, source, by="") -> str:
    """CTE ``fit``: one wide row (per ``by``) of the fitted statistics."""
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    parts = ", ".join(
        f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, median({c}) AS {c}_median, mad({c}) AS {c}_mad, quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in columns
    )
    return f"fit AS (SELECT {keys}{parts} FROM {source}{group})"


def _zero(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 1e-10 ELSE {c} END"


def _mod_z(c: str) -> str:
    return f"abs({c} - {c}_median) * 0.6745 / ({_zero(c + '_mad')})"


def _capped_sql(z: str) -> str:
    return f"CASE WHEN ({z}) IS NULL THEN 0 ELSE least(({z}) / 6.0, 1) END"


def _score_sql(columns) -> str:
    return "greatest(0, " + ", ".join(_capped_sql(_mod_z(c)) for c in columns) + ")"


FLAGS = {
    "zscore": lambda c: f"abs({c} - {c}_mean) / ({_zero(c + '_std')}) > 3",
    "modified_zscore": lambda c: f"{_mod_z(c)} > 3",
    "iqr": lambda c: f"({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1))",
}


def _flag_sql(method, columns) -> str:
    return " OR ".join(f"coalesce({FLAGS[method](c)}, false)" for c in columns)


def _stat_sql(method: str) -> str:
    return sql_with("sales", f"WITH {_fit_sql(METRICS, 'sales')} SELECT l_orderkey, l_linenumber, total_amount, {_flag_sql(method, METRICS)} AS is_anomaly FROM sales, fit")


def _stat(spark, d, method):
    lines = _lines(spark, d)
    out = stat.detect(lines, stat.fit_statistics(lines, METRICS), method)
    return out.select("l_orderkey", "l_linenumber", "total_amount", "is_anomaly")


@query(
    "anomaly_fit",
    sql_with(
        "sales",
        " UNION ALL ".join(
            f"""SELECT warehouse_location, '{c}' AS metric, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 4) AS std, round(median({c}), 5) AS median, round(mad({c}), 5) AS mad,
                round(quantile_cont({c}, 0.25), 5) AS q1, round(quantile_cont({c}, 0.75), 5) AS q3 FROM sales GROUP BY 1"""
            for c in METRICS
        ),
    ),
)
def anomaly_fit(spark, d):
    model = stat.fit_statistics(materialize(v.sales(spark, d, "warehouse_location", *METRICS)), METRICS, ["warehouse_location"])
    digits = {"mean": 3, "std": 4, "median": 5, "mad": 5, "q1": 5, "q3": 5}
    return model.long().withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("anomaly_stat_z", _stat_sql("zscore"))
def anomaly_stat_z(spark, d):
    return _stat(spark, d, "zscore")


@query("anomaly_stat_mad", _stat_sql("modified_zscore"))
def anomaly_stat_mad(spark, d):
    return _stat(spark, d, "modified_zscore")


@query("anomaly_stat_iqr", _stat_sql("iqr"))
def anomaly_stat_iqr(spark, d):
    return _stat(spark, d, "iqr")


@query(
    "anomaly_stat_score",
    sql_with(
        "inventory",
        f"""WITH {_fit_sql(STOCK, "inventory", "warehouse_location")} SELECT product_id, warehouse_location, {_score_sql(STOCK)} AS anomaly_score,
            {_flag_sql("modified_zscore", STOCK)} AS is_anomaly FROM inventory JOIN fit USING (warehouse_location)""",
    ),
)
def anomaly_stat_score(spark, d):
    stock = materialize(v.inventory(spark, d).select("product_id", "warehouse_location", *STOCK))
    out = stat.detect(stock, stat.fit_statistics(stock, STOCK, ["warehouse_location"]))
    return out.select("product_id", "warehouse_location", "anomaly_score", "is_anomaly")


# ---------------------------------------------------------------- time series

ROLLED = """rolled AS (SELECT *, avg(y) OVER w AS rm, CASE WHEN stddev_samp(y) OVER w = 0 THEN 1e-10 ELSE stddev_samp(y) OVER w END AS rs,
               lag(y) OVER e AS before, lead(y) OVER e AS after
        FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), e AS (PARTITION BY entity_id ORDER BY ds)),
    scored AS (SELECT *, abs(y - rm) / rs AS z, coalesce(before < y AND after < y, false) AS is_peak FROM rolled)"""


@query(
    "rolling_z",
    sql_with(
        "daily",
        f"""WITH {ROLLED} SELECT entity_id, ds, y, coalesce(z > 3, false) OR (is_peak AND coalesce(y >= rm + 3 * rs, false)) AS is_anomaly, round({_capped_sql("z")}, 6) AS anomaly_score FROM scored""",
    ),
)
def rolling_z(spark, d):
    out = ts.detect_series(v.daily(spark, d).select("entity_id", "ds", "y"))
    return out.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("peaks", sql_with("daily", f"WITH {ROLLED} SELECT entity_id, ds, y, is_peak FROM scored"))
def peaks(spark, d):
    return ts.peaks(v.daily(spark, d).select("entity_id", "ds", "y"))


@query("spikes", sql_with("daily", f"WITH {ROLLED} SELECT entity_id, ds, y, round(rm + 3 * rs, 3) AS height FROM scored WHERE is_peak AND y >= rm + 3 * rs"))
def spikes(spark, d):
    rolled = ts.peaks(ts.rolling_scores(v.daily(spark, d), ["y"]))
    return rolled.filter(F.col("is_peak") & (F.col("y") >= F.col("y_height"))).select("entity_id", "ds", "y", F.round("y_height", 3).alias("height"))


NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds) - 1 AS i, row_number() OVER (PARTITION BY entity_id ORDER BY ds DESC) AS age FROM daily)"


@query(
    "ts_fit",
    sql_with(
        "daily",
        f"""WITH {NUMBERED} SELECT entity_id, count(*) AS n, round(avg(y) FILTER (age <= 30), 3) AS rolling_mean, round(stddev_samp(y) FILTER (age <= 30), 3) AS rolling_std, round(regr_slope(y, i), 6) AS trend
            FROM numbered GROUP BY 1 HAVING count(*) >= 30""",
    ),
)
def ts_fit(spark, d):
    out = ts.fit_series(v.daily(spark, d))
    return out.withColumns({"rolling_mean": F.round("rolling_mean", 3), "rolling_std": F.round("rolling_std", 3), "trend": F.round("trend", 6)})


@query("seasonal_factors", sql_with("daily", f"WITH {NUMBERED} SELECT entity_id, (i % 7)::INTEGER AS position, round(avg(y), 3) AS factor FROM numbered GROUP BY 1, 2"))
def seasonal_factors(spark, d):
    return ts.seasonal_factors(v.daily(spark, d)).withColumn("factor", F.round("factor", 3))


# ---------------------------------------------------------------- machine learning


def _scaled_sql(c: str) -> str:
    filled = f"coalesce({c}, (SELECT median({c}) FROM inventory))"
    iqr = f"(SELECT quantile_cont({filled}, 0.75) - quantile_cont({filled}, 0.25) FROM inventory)"
    return f"round(({filled} - (SELECT median({c}) FROM inventory)) / {iqr}, 6) AS {c}_scaled"


@query("ml_scaled", sql_with("inventory", f"SELECT product_id, warehouse_location, {', '.join(map(_scaled_sql, STOCK))} FROM inventory"))
def ml_scaled(spark, d):
    stock = materialize(v.inventory(spark, d).select("product_id", "warehouse_location", *STOCK))
    out = ml.scale(stock, ml.fit_scaling(stock, STOCK))
    return out.select("product_id", "warehouse_location", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in STOCK])


@query(
    "pca_error",
    sql_with(
        "daily",
        """WITH q AS (SELECT *, (y - (SELECT median(y) FROM daily)) / (SELECT quantile_cont(y, 0.75) - quantile_cont(y, 0.25) FROM daily) AS a,
                     (q - (SELECT median(q) FROM daily)) / (SELECT quantile_cont(q, 0.75) - quantile_cont(q, 0.25) FROM daily) AS b FROM daily),
        m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM q),
        e AS (SELECT *, (va + vb) / 2 + sqrt((va - vb) * (va - vb) / 4 + c * c) AS top FROM m),
        n AS (SELECT *, c / sqrt(c * c + (top - va) * (top - va)) AS u, (top - va) / sqrt(c * c + (top - va) * (top - va)) AS w FROM e),
        r AS (SELECT entity_id, ds, pow((a - ma) * w - (b - mb) * u, 2) / 2 AS err FROM q, n)
        SELECT entity_id, ds, round(err, 6) AS pca_error, err > (SELECT quantile_cont(err, 0.95) FROM r) AS pca_flag FROM r""",
    ),
)
def pca_error(spark, d):
    series = materialize(v.daily(spark, d))
    out = ml.pca_detect(series, ml.fit_components(series, ml.fit_scaling(series, ["y", "q"])))
    return out.select("entity_id", "ds", F.round("pca_error", 6).alias("pca_error"), "pca_flag")


LINES_X = sql_models.scaled("sales", METRICS, "l_orderkey, l_linenumber")
DAILY_X = sql_models.scaled("daily", ["y", "q"], "entity_id, ds")


def _forest_sql(forest: str) -> str:
    return sql_with(
        "sales",
        f"""WITH {LINES_X},\n{forest}
        SELECT l_orderkey, l_linenumber, score AS isolation, forest_flag, round(ml_score, 6) AS ml_score FROM x JOIN forest USING (id)""",
    )


def _forest_rows(lines, forest):
    out = ml.forest_detect(lines, forest)
    return out.select("l_orderkey", "l_linenumber", "isolation", "forest_flag", F.round("ml_score", 6).alias("ml_score"))


@query("iforest", _forest_sql(sql_models.forest(3, ml.TREES, ml.SAMPLE, 8)))
def iforest(spark, d):
    lines = _lines(spark, d)
    return _forest_rows(lines, ml.fit_forest(lines, ml.fit_scaling(lines, METRICS)))


@query("iforest_small", _forest_sql(sql_models.forest(3, 8, 8, 3)))
def iforest_small(spark, d):
    lines = _lines(spark, d)
    return _forest_rows(lines, ml.fit_forest(lines, ml.fit_scaling(lines, METRICS), trees=8, sample=8))


@query("robust_cov")
def robust_cov(spark, d):
    lines = _lines(spark, d)
    ellipse = ml.fit_ellipse(lines, ml.fit_scaling(lines, METRICS))
    return ml.ellipse_detect(lines, ellipse).select("l_orderkey", "l_linenumber", "mahalanobis2", "ellipse_flag")


@query(
    "robust_cov_pair",
    sql_with("daily", f"""WITH {DAILY_X},\n{sql_models.ellipse()}
        SELECT entity_id, ds, round(d2, 6) AS mahalanobis2, ellipse_flag FROM x JOIN ellipse USING (id)"""),
)
def robust_cov_pair(spark, d):
    series = materialize(v.daily(spark, d))
    out = ml.ellipse_detect(series, ml.fit_ellipse(series, ml.fit_scaling(series, ["y", "q"])))
    return out.select("entity_id", "ds", F.round("mahalanobis2", 6).alias("mahalanobis2"), "ellipse_flag")


VOTES = "forest_flag::INT + ellipse_flag::INT + pca_flag::INT"
#: CTEs of all three detectors over the daily rows, up to ``votes`` (id, ml_votes, ml_score).
VOTE_SQL = f"""{DAILY_X},
{sql_models.forest(2, ml.TREES, ml.SAMPLE, 8)},
{sql_models.ellipse()},
{sql_models.residual()},
votes AS MATERIALIZED (SELECT id, {VOTES} AS ml_votes, ml_score FROM forest JOIN ellipse USING (id) JOIN residual USING (id))"""


@query("anomaly_ml_vote", sql_with("daily", f"""WITH {VOTE_SQL}
    SELECT entity_id, ds, ml_votes, ml_votes >= 2 AS ml_flag, round(ml_score, 6) AS ml_score FROM x JOIN votes USING (id)"""))
def anomaly_ml_vote(spark, d):
    series = materialize(v.daily(spark, d))
    out = ml.ml_detect(series, ml.fit_ml(series, ["y", "q"]))
    return out.select("entity_id", "ds", "ml_votes", "ml_flag", F.round("ml_score", 6).alias("ml_score"))


# ---------------------------------------------------------------- ensemble and records


def _detector_scores(spark, d):
    """Daily rows with the statistical and time-series scores, and the fitted statistics."""
    series = materialize(v.daily(spark, d))
    model = stat.fit_statistics(series, ["y", "q"])
    scored = stat.detect(series, model, flag="stat_flag", score="stat_score")
    rolled = ts.detect_series(series, ["y", "q"]).select("entity_id", "ds", F.col("anomaly_score").alias("ts_score"))
    return scored.join(rolled, ["entity_id", "ds"]), model


def _two_part(spark, d):
    scored, model = _detector_scores(spark, d)
    return ens.ensemble_score(scored, {"statistical": "stat_score", "timeseries": "ts_score"}, rescale=True), model


ENSEMBLE = f"""{_fit_sql(["y", "q"], "daily")},
    rolled AS (SELECT *, {", ".join(f"abs({c} - avg({c}) OVER w) / CASE WHEN stddev_samp({c}) OVER w = 0 THEN 1e-10 ELSE stddev_samp({c}) OVER w END AS z{c}" for c in ("y", "q"))}
       FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    scored AS (SELECT *, {_score_sql(["y", "q"])} AS stat_score, greatest(0, {_capped_sql("zy")}, {_capped_sql("zq")}) AS ts_score FROM rolled, fit),
    ens AS (SELECT *, (stat_score * 0.35::DOUBLE + ts_score * 0.25::DOUBLE) / 0.60::DOUBLE AS score FROM scored)"""


@query("anomaly_ensemble_stat_ts", sql_with("daily", f"WITH {ENSEMBLE} SELECT entity_id, ds, stat_score, round(ts_score, 6) AS ts_score, round(score, 6) AS ensemble_score FROM ens"))
def anomaly_ensemble_stat_ts(spark, d):
    out, _ = _two_part(spark, d)
    return out.select("entity_id", "ds", "stat_score", *[F.round(c, 6).alias(c) for c in ("ts_score", "ensemble_score")])


#: CTEs of the three-part ensemble; ``ens`` has the score of each daily row.
FULL_ENSEMBLE = f"""{_fit_sql(["y", "q"], "daily")},
    {VOTE_SQL},
    rolled AS (SELECT *, {", ".join(f"abs({c} - avg({c}) OVER w) / CASE WHEN stddev_samp({c}) OVER w = 0 THEN 1e-10 ELSE stddev_samp({c}) OVER w END AS z{c}" for c in ("y", "q"))}
       FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    scored AS (SELECT *, {_score_sql(["y", "q"])} AS stat_score, greatest(0, {_capped_sql("zy")}, {_capped_sql("zq")}) AS ts_score FROM rolled, fit),
    ens AS (SELECT scored.*, ml_score, stat_score * 0.35::DOUBLE + ml_score * 0.40::DOUBLE + ts_score * 0.25::DOUBLE AS score
       FROM scored JOIN x USING (entity_id, ds) JOIN votes USING (id))"""


def _three_part(spark, d):
    """Daily rows with the scores of all three detectors and their ensemble, and the fitted statistics."""
    scored, model = _detector_scores(spark, d)
    scored = materialize(scored)
    out = ml.ml_detect(scored, ml.fit_ml(scored, ["y", "q"]))
    return ens.ensemble_score(out, {"statistical": "stat_score", "ml": "ml_score", "timeseries": "ts_score"}), model


@query(
    "anomaly_ensemble",
    sql_with("daily", f"""WITH {FULL_ENSEMBLE} SELECT entity_id, ds, stat_score, round(ml_score, 6) AS ml_score, round(ts_score, 6) AS ts_score, round(score, 6) AS ensemble_score,
        score > 0.5 AS is_anomaly FROM ens"""),
)
def anomaly_ensemble(spark, d):
    out, _ = _three_part(spark, d)
    rounded = [F.round(c, 6).alias(c) for c in ("ml_score", "ts_score", "ensemble_score")]
    return out.select("entity_id", "ds", "stat_score", *rounded, (F.col("ensemble_score") > ens.MIN_CONFIDENCE).alias("is_anomaly"))


def _factor_sql(c: str, i: int) -> str:
    sigma = f"({c} - {c}_mean) / {c}_std"
    return f"CASE WHEN abs({sigma}) > 1.5 THEN {{'k': -abs({sigma}), 'i': {i}, 't': '{c}:' || CASE WHEN abs({sigma}) > 3 THEN 'high' ELSE 'moderate' END, 'high': (abs({sigma}) > 3)::INT}} END"


_RECORDS = f"""
    factored AS (SELECT *, list_sort(list_filter([{_factor_sql("y", 0)}, {_factor_sql("q", 1)}], lambda x: x IS NOT NULL)) AS f,
        {_capped_sql(_mod_z("q"))} > {_capped_sql(_mod_z("y"))} AS by_q FROM ens WHERE score > 0.5),
    graded AS (SELECT *, CASE WHEN score > 0.9 OR list_sum(list_transform(f, lambda x: x.high)) >= 3 THEN 'critical' WHEN score > 0.7 OR list_sum(list_transform(f, lambda x: x.high)) >= 1 THEN 'warning' ELSE 'info' END AS severity FROM factored),
    records AS (SELECT CASE WHEN by_q THEN 'q' ELSE 'y' END AS metric_name, entity_id, ds::TIMESTAMP AS timestamp, CASE WHEN by_q THEN q ELSE y END AS actual_value,
        CASE WHEN by_q THEN q_median ELSE y_median END AS expected_value, score * 100 AS deviation_percentage, score * 3 AS z_score, severity, score AS confidence_score,
        array_to_string(list_transform(f, lambda x: x.t), ',') AS factors,
        'Investigate the anomaly and review related processes.' || CASE WHEN severity = 'critical' THEN ' URGENT: Escalate to management immediately.' ELSE '' END AS recommendation FROM graded)"""
RECORDS, FULL_RECORDS = f"{ENSEMBLE},{_RECORDS}", f"{FULL_ENSEMBLE},{_RECORDS}"


RECORD_SQL = """metric_name, entity_id, timestamp, actual_value, round(expected_value, 4) AS expected_value, round(deviation_percentage, 4) AS deviation_percentage,
            round(z_score, 6) AS z_score, severity, round(confidence_score, 6) AS confidence_score, factors, recommendation"""


def _flat(records):
    factors = F.array_join(F.transform("contributing_factors", lambda f: F.concat_ws(":", f["factor"], f["impact"])), ",")
    out = records.withColumn("factors", factors).drop("contributing_factors", "is_acknowledged", "is_resolved")
    return out.withColumns({c: F.round(c, n) for c, n in (("expected_value", 4), ("deviation_percentage", 4), ("z_score", 6), ("confidence_score", 6))})


def records(spark, d):
    """Records of all three detectors."""
    scored, model = _three_part(spark, d)
    return ens.anomaly_records(scored, model, "entity_id", "ds")


@query("anomaly_records", sql_with("daily", f"WITH {RECORDS} SELECT {RECORD_SQL}, 'ensemble_statistical_timeseries' AS algorithm_used FROM records"))
def anomaly_records(spark, d):
    scored, model = _two_part(spark, d)
    return _flat(ens.anomaly_records(scored, model, "entity_id", "ds", algorithm="ensemble_statistical_timeseries"))


@query("anomaly_records_ensemble", sql_with("daily", f"WITH {FULL_RECORDS} SELECT {RECORD_SQL}, 'ensemble_statistical_ml_timeseries' AS algorithm_used FROM records"))
def anomaly_records_ensemble(spark, d):
    return _flat(records(spark, d))


@query("anomaly_valid", sql_with("daily", f"WITH {FULL_RECORDS} SELECT 'confidence_range' AS rule, count(*) FILTER (NOT confidence_score BETWEEN 0 AND 1) AS failed_records FROM records"))
def anomaly_valid(spark, d):
    return rule_failures(records(spark, d), anomaly_rules())


@query(
    "recent_anomalies",
    sql_with(
        "daily",
        f"""WITH {FULL_RECORDS} SELECT timestamp, metric_name AS metric, entity_id, upper(severity) AS severity, round(deviation_percentage, 2) AS deviation, 'open' AS status FROM records
            ORDER BY timestamp DESC, confidence_score DESC, entity_id, actual_value LIMIT 10""",
    ),
)
def recent_anomalies(spark, d):
    return kpi.recent_anomalies(records(spark, d))


@query(
    "anomaly_filter",
    sql_with(
        "daily",
        f"""WITH {FULL_RECORDS} SELECT metric_name, entity_id, timestamp, severity FROM records
            WHERE severity IN ('critical', 'warning') AND timestamp > TIMESTAMP '1998-06-30' - INTERVAL 30 DAY AND timestamp <= TIMESTAMP '1998-06-30'""",
    ),
)
def anomaly_filter(spark, d):
    return kpi.filter_anomalies(records(spark, d), datetime(1998, 6, 30), time_range="30d").select("metric_name", "entity_id", "timestamp", "severity")


@query("anomaly_timeline", sql_with("daily", f"WITH {FULL_RECORDS} SELECT date_trunc('month', timestamp)::DATE AS ds, severity, count(*) AS n FROM records GROUP BY 1, 2"))
def anomaly_timeline(spark, d):
    return kpi.anomaly_timeline(records(spark, d), "month")


EVENT_FIT = _fit_sql(["value"], "events")


@query("anomaly_stream", f"WITH {EVENT_FIT} SELECT event_id, value, round({_score_sql(['value'])}, 6) AS anomaly_score, {_flag_sql('modified_zscore', ['value'])} AS is_anomaly FROM events, fit")
def anomaly_stream(spark, d):
    events = v.table(spark, d, "events").select("event_id", "value")
    folder, out = scratch_path(spark, "events-in"), scratch_path(spark, "events-scored")
    events.repartition(4).write.parquet(folder)  # four files, one at a trigger
    chunks = jobs.parquet_chunks(spark, folder, events.schema)
    scored = jobs.score_stream(chunks, stat.fit_statistics(events, ["value"]))
    jobs.write_stream(scored, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/data").withColumn("anomaly_score", F.round("anomaly_score", 6))
