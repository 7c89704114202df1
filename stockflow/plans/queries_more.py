"""Queries on cases beside the plain tables: binding caps, quoted cells, signed totals, missing cells, further rules and reports."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from stockflow.operators import aggregate as agg
from stockflow.operators import alerts as al
from stockflow.operators import anomaly_ml as ml
from stockflow.operators import forecast as fc
from stockflow.operators import quality as qu
from stockflow.operators import stats as st
from stockflow.operators.anomaly_ensemble import user_ensemble as user_detectors
from stockflow.operators.forecast import user_ensemble as user_forecasters
from stockflow.plans import kpi
from stockflow.plans import views as v
from stockflow.plans.queries_alerts import streamed
from stockflow.plans.registry import query
from stockflow.plans.views import sql_with
from stockflow.session import materialize, scratch_path
from stockflow.sources import files, sinks
from stockflow.streaming import jobs

AS_OF = datetime(2001, 1, 1)

# ---------------------------------------------------------------- alerts under a binding cap

# Alert by alert: a decision needs the send times of the last hour, so the chain is walked with them in a list.
CAPPED = """numbered AS (SELECT *, alert_id % 9 <> 0 AS delivered, row_number() OVER (PARTITION BY rate_key ORDER BY ts, alert_id) AS rn FROM alerts),
       walked AS (SELECT rate_key, rn, alert_id, ts, delivered AS sent, CASE WHEN delivered THEN [ts] ELSE []::TIMESTAMP[] END AS sends FROM numbered WHERE rn = 1
                  UNION ALL
                  SELECT rate_key, rn, alert_id, ts, ok, CASE WHEN ok THEN list_append(list_filter(sends, lambda t: ts - t < INTERVAL 1 HOUR), ts) ELSE sends END
                  FROM (SELECT n.rate_key, n.rn, n.alert_id, n.ts, w.sends,
                               n.delivered AND (len(w.sends) = 0 OR n.ts - w.sends[-1] >= (CASE WHEN n.dedup_key IS NULL THEN INTERVAL 1 MINUTE ELSE INTERVAL 60 MINUTE END))
                                 AND len(list_filter(w.sends, lambda t: n.ts - t < INTERVAL 1 HOUR)) < 2 AS ok
                        FROM walked w JOIN numbered n ON n.rate_key = w.rate_key AND n.rn = w.rn + 1))"""


def _capped(spark, d):
    return v.alerts(spark, d).withColumn("delivered", F.col("alert_id") % 9 != 0)


@query("alert_suppress_capped", sql_with("alerts", f"WITH {CAPPED} SELECT alert_id, rate_key, ts, sent FROM walked", recursive=True))
def alert_suppress_capped(spark, d):
    return al.suppress(_capped(spark, d), cooldown_minutes=1, max_per_hour=2).select("alert_id", "rate_key", "ts", "sent")


@query("alert_stream_capped", sql_with("alerts", f"WITH {CAPPED} SELECT alert_id, rate_key, ts, sent FROM walked", recursive=True))
def alert_stream_capped(spark, d):
    return streamed(spark, _capped(spark, d), cooldown_minutes=1, max_per_hour=2)


@query(
    "alert_routing_explicit",
    """SELECT event_id AS alert_id, array_to_string(list_filter(CASE WHEN event_id % 4 = 0 THEN ['slack', 'pager'] WHEN event_id % 4 = 1 THEN ['pager']
         ELSE (CASE WHEN value >= 100 THEN ['email', 'slack'] ELSE ['slack'] END) END, lambda c: c IN ('email', 'slack')), ',') AS channels FROM events""",
)
def alert_routing_explicit(spark, d):
    asked = F.when(F.col("alert_id") % 4 == 0, F.array(F.lit("slack"), F.lit("pager"))).when(F.col("alert_id") % 4 == 1, F.array(F.lit("pager")))
    routed = al.route(v.alerts(spark, d).withColumn("asked", asked), explicit="asked")
    return routed.select("alert_id", F.array_join("channels", ",").alias("channels"))


# ---------------------------------------------------------------- sources


@query("csv_quoted", "SELECT doc_id, text, lang FROM documents")
def csv_quoted(spark, d):
    # Texts hold commas, quotes and line breaks.
    path = scratch_path(spark, "quoted")
    sinks.write_csv(v.table(spark, d, "documents").select("doc_id", "text", "lang"), path, delimiter=";")
    return files.csv_scan(spark, path, "doc_id BIGINT, text STRING, lang STRING", delimiter=";", multi_line=True)


@query("csv_bad_rows", "SELECT count(*) AS records, count(*) FILTER (o_orderkey % 10 = 3) AS bad_records FROM orders")
def csv_bad_rows(spark, d):
    path = scratch_path(spark, "bad-rows")
    key = F.col("o_orderkey")
    sinks.write_csv(v.table(spark, d, "orders").select(F.when(key % 10 == 3, F.concat(F.lit("x"), key)).otherwise(key.cast("string")).alias("o_orderkey"), "o_totalprice"), path)
    return files.count_bad_rows(files.csv_scan(spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE", bad_rows="bad"), "bad")


def _paged_orders(spark, d):
    """Orders by priority as paged bodies of 100 order keys; page 3 of '5-LOW' cannot be read."""
    orders = v.table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    page = F.floor(F.col("o_orderkey") / 100)
    bodies = orders.groupBy(F.col("o_orderpriority").alias("source"), page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey"))).alias("results"))
    body = F.to_json(F.struct("results", F.lit(True).alias("has_next")))
    return bodies.select("source", "page", F.when((F.col("source") == "5-LOW") & (F.col("page") == 3), "<html>").otherwise(body).alias("body"))


PAGED = """orders_paged AS (SELECT o_orderpriority AS source, o_orderkey // 100 AS page, o_orderkey FROM orders),
       kept AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY page) AS nth FROM orders_paged)"""


@query("json_pages_first", f"WITH {PAGED} SELECT source, page, o_orderkey FROM kept WHERE nth <= 5 AND NOT (source = '5-LOW' AND page >= 3)")
def json_pages_first(spark, d):
    return files.json_pages(_paged_orders(spark, d), "o_orderkey BIGINT", ["source"], max_pages=5)


@query("json_pages_unreadable", "SELECT '5-LOW' AS source, 3::BIGINT AS page, 'unreadable body: <html>' AS error FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey // 100 = 3 LIMIT 1")
def json_pages_unreadable(spark, d):
    return files.unreadable_pages(_paged_orders(spark, d), "o_orderkey BIGINT", ["source"])


@query("scan_metrics_full", "SELECT count(*)::BIGINT AS records_extracted, 1::BIGINT AS files, 0::BIGINT AS errors, true AS has_bytes, true AS has_time FROM lineitem")
def scan_metrics_full(spark, d):
    found = files.scan_metrics(v.table(spark, d, "lineitem"))
    return found.select("records_extracted", "files", "errors", (F.col("bytes_processed") > 0).alias("has_bytes"), (F.col("elapsed_seconds") > 0).alias("has_time"))


# ---------------------------------------------------------------- aggregation and statistics


@query(
    "agg_user_functions",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, max(l_quantity) - min(l_quantity) AS l_quantity_user, max(l_quantity) - 1 AS l_quantity_user_2,
         count(*) AS l_orderkey FROM lineitem GROUP BY 1, 2""",
)
def agg_user_functions(spark, d):
    # Four groups hold all rows: no task may see one whole.
    def ends(state, values):
        return [min(state[0], values.min()), max(state[1], values.max())] if len(values) else state

    def both(a, b):
        return [min(a[0], b[0]), max(a[1], b[1])]

    nothing = (float("inf"), float("-inf"))
    users = [agg.Mergeable("user", nothing, ends, both, lambda s: s[1] - s[0]), agg.Mergeable("user", nothing, ends, both, lambda s: s[1] - 1)]
    return agg.aggregate(v.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": ["sum", *users], "l_orderkey": "count"})


@query(
    "abc_signed",
    """WITH items AS (SELECT c_custkey AS item, round(sum(c_acctbal), 4) AS total_value FROM customer GROUP BY 1),
       placed AS (SELECT *, total_value / sum(total_value) OVER () * 100 AS value_pct,
                  sum(total_value) OVER (ORDER BY total_value DESC, item ROWS UNBOUNDED PRECEDING) / sum(total_value) OVER () * 100 AS cumulative_pct FROM items)
       SELECT item, total_value, round(value_pct, 6) AS value_pct, round(cumulative_pct, 6) AS cumulative_pct,
              CASE WHEN cumulative_pct <= 80 THEN 'A' WHEN cumulative_pct <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM placed""",
)
def abc_signed(spark, d):
    # Balances below zero: the total is not the greatest running total.
    out = st.abc_analysis(v.table(spark, d, "customer"), "c_acctbal", "c_custkey", digits=4)
    return out.withColumns({c: F.round(c, 6) for c in ("value_pct", "cumulative_pct")})


@query(
    "describe_gaps",
    """SELECT 'p_retailprice' AS column_name, count(x) AS count, count(*) - count(x) AS missing, round((count(*) - count(x)) / count(*) * 100, 2) AS missing_pct,
         round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(min(x), 4) AS min, round(max(x), 4) AS max
       FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS x FROM part)
       UNION ALL SELECT 'nothing', 0, 0, NULL, NULL, NULL, NULL, NULL FROM part HAVING count(*) > 0""",
)
def describe_gaps(spark, d):
    # NaN counts as missing, and a table without rows has no figures.
    part = v.table(spark, d, "part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice")))
    columns = ["column_name", "count", "missing", "missing_pct", "mean", "median", "min", "max"]
    empty = st.describe(part.filter("p_partkey < 0").withColumnRenamed("p_retailprice", "nothing"), ["nothing"])
    return st.describe(part, ["p_retailprice"]).select(columns).unionByName(empty.select(columns))


# ---------------------------------------------------------------- rules, quality, reports

STOCKED = """SELECT p_partkey AS product_id, p_size - 5 AS minimum_order_quantity, p_size - 3 AS reorder_point, p_size - 2 AS safety_stock_level,
                    CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN -1.0 ELSE p_size * 1.0 END::DOUBLE AS weight_kg FROM part"""


@query(
    "validate_stock_levels",
    f"""WITH p AS ({STOCKED}) SELECT product_id, array_to_string(list_filter([CASE WHEN minimum_order_quantity < 0 THEN 'minimum_order_quantity_non_negative' END,
          CASE WHEN reorder_point < 0 THEN 'reorder_point_non_negative' END, CASE WHEN safety_stock_level < 0 THEN 'safety_stock_level_non_negative' END,
          CASE WHEN weight_kg <= 0 THEN 'weight_kg_positive' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM p""",
)
def validate_stock_levels(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    weight = F.when(key % 11 == 0, None).when(key % 7 == 0, -1.0).otherwise(size.cast("double"))
    parts = v.table(spark, d, "part").select(key.alias("product_id"), (size - 5).alias("minimum_order_quantity"), (size - 3).alias("reorder_point"), (size - 2).alias("safety_stock_level"), weight.alias("weight_kg"))
    return qu.validate(parts, qu.stock_level_rules()).select("product_id", F.array_join("failed_rules", ",").alias("failed_rules"))


@query(
    "orphan_lines",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)",
)
def orphan_lines(spark, d):
    small = v.table(spark, d, "part").filter("p_size <= 40")
    return qu.orphans(v.table(spark, d, "lineitem"), "l_partkey", small, "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "quality_log",
    """WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderdate > TIMESTAMP '1997-01-01') AS future FROM orders)
       SELECT 'no_future_dates' AS check_name, n AS total_records, future AS failed_records, 'failed_records=' || future || ',total_records=' || n AS details,
              TIMESTAMP '2001-01-01' AS checked_at FROM o""",
)
def quality_log(spark, d):
    orders = v.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("order_date"))
    checks = qu.quality_checks(orders, "orders", F.lit(datetime(1997, 1, 1)))
    path = scratch_path(spark, "quality-log")
    qu.append_quality_log(checks, path, F.lit(AS_OF))
    log = spark.read.parquet(path).filter("check_name = 'no_future_dates'")
    details = F.array_join(F.transform(F.sort_array(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return log.select("check_name", "total_records", "failed_records", details.alias("details"), F.col("checked_at").cast("timestamp_ntz").alias("checked_at"))


def _report_sql(unit: str, end: str) -> str:
    return sql_with(
        "sales",
        f"""WITH p AS (SELECT warehouse_location, date_trunc('{unit}', order_date)::DATE AS d, count(*) AS lines, sum(quantity) AS units, round(sum(total_amount), 4) AS revenue FROM sales GROUP BY ALL),
        b AS (SELECT warehouse_location, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 {unit}))::DATE AS d FROM p GROUP BY 1)
        SELECT warehouse_location, {end} AS period_end, coalesce(lines, 0) AS lines, coalesce(units, 0) AS units, coalesce(revenue, 0) AS revenue FROM b LEFT JOIN p USING (warehouse_location, d)""",
    )


def _report(spark, d, freq: str):
    return kpi.periodic_report(v.sales(spark, d, "warehouse_location", "order_date", "total_amount", "quantity"), freq)


@query("report_daily", _report_sql("day", "d"))
def report_daily(spark, d):
    return _report(spark, d, "D")


@query("report_monthly", _report_sql("month", "last_day(d)"))
def report_monthly(spark, d):
    return _report(spark, d, "M")


@query(
    "kpi_turnover",
    sql_with(
        "inventory",
        """WITH stock AS (SELECT sum(quantity_on_hand) AS on_hand FROM inventory), months AS (SELECT strftime(order_date, '%Y-%m') AS month, sum(quantity) AS units FROM sales GROUP BY 1),
        t AS (SELECT month, units, units * 12 / on_hand AS turnover FROM months, stock)
        SELECT month, units, round(turnover, 6) AS turnover, round(turnover - lag(turnover) OVER (ORDER BY month), 6) AS turnover_change FROM t""",
    ),
)
def kpi_turnover(spark, d):
    return kpi.turnover(v.sales(spark, d, "order_date", "quantity"), v.inventory(spark, d))


@query(
    "mann_kendall_products",
    sql_with(
        "sales",
        """WITH s AS (SELECT product_id AS entity_id, date_trunc('month', order_date)::DATE AS ds, round(avg(total_amount), 4) AS y FROM sales GROUP BY ALL),
        pairs AS (SELECT a.entity_id, sum(sign(b.y - a.y)) AS s FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.ds < b.ds GROUP BY 1),
        sizes AS (SELECT entity_id, count(*) AS n FROM s GROUP BY 1)
        SELECT entity_id, n, CASE WHEN n < 3 THEN 0 ELSE coalesce(pairs.s, 0) END::DOUBLE AS statistic FROM sizes LEFT JOIN pairs USING (entity_id)""",
    ),
)
def mann_kendall_products(spark, d):
    means = st.period_means(v.sales(spark, d, "product_id", "order_date", "total_amount"), "product_id", "order_date", "total_amount")
    return st.mann_kendall(means.withColumn("y", F.round("y", 4))).select("entity_id", "n", "statistic")


# ---------------------------------------------------------------- users' own detectors and forecasters


class _ShareOfMean:
    """A detector: a value's share of ten times the entity's mean."""

    def fit(self, df):
        return df.groupBy("entity_id").agg(F.avg("y").alias("_mean"))

    def score(self, df, model):
        score = F.greatest(F.lit(0.0), F.least(F.col("y") / (10 * F.col("_mean")), F.lit(1.0)))
        return df.join(model, "entity_id").withColumn("anomaly_score", score).withColumn("is_anomaly", score > 0.5).drop("_mean")


class _Share:
    """A detector: a value's share of twice the greatest value."""

    def fit(self, df):
        return df.agg(F.max("y")).first()[0]

    def score(self, df, model):
        return df.withColumns({"anomaly_score": F.greatest(F.lit(0.0), F.col("y") / (2 * model)), "is_anomaly": F.lit(False)})


@query(
    "ensemble_user_detectors",
    sql_with(
        "daily",
        """SELECT entity_id, ds, round((greatest(0, least(y / (10 * avg(y) OVER (PARTITION BY entity_id)), 1)) * 0.3::DOUBLE + greatest(0, y / (2 * max(y) OVER ())) * 0.35::DOUBLE) / 0.65::DOUBLE, 9) AS ensemble_score
           FROM daily""",
    ),
)
def ensemble_user_detectors(spark, d):
    out = user_detectors(v.daily(spark, d), {"own": _ShareOfMean(), "statistical": _Share()})
    return out.select("entity_id", "ds", F.round("ensemble_score", 9).alias("ensemble_score"))


class _Constant:
    """A forecaster that repeats one figure of the series."""

    def __init__(self, figure):
        self.figure = figure

    def forecast(self, series, horizon):
        last = series.groupBy("entity_id").agg(self.figure.alias("predicted"), F.max("ds").alias("_last"))
        steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        return steps.select("entity_id", "step", F.date_add("_last", F.col("step")).alias("ds"), "predicted")


@query(
    "ensemble_user_forecasters",
    sql_with(
        "daily",
        """WITH f AS (SELECT entity_id, (arg_max(y, ds) + max(y)) / 2 AS p, max(ds) AS last FROM daily GROUP BY 1)
        SELECT entity_id, s::INTEGER AS step, (last + s::INTEGER)::DATE AS ds, round(p, 6) AS predicted FROM f, generate_series(1, 5) AS t(s)""",
    ),
)
def ensemble_user_forecasters(spark, d):
    mixed = user_forecasters(v.daily(spark, d), {"last": _Constant(F.max_by("y", "ds")), "most": _Constant(F.max("y"))}, 5)
    return mixed.select("entity_id", "step", "ds", F.round("predicted", 6).alias("predicted"))


# ---------------------------------------------------------------- facts about fits that have no SQL of their own


@query("hw_fit_facts", sql_with("daily", "SELECT DISTINCT entity_id, true AS not_worse, true AS in_range FROM daily"))
def hw_fit_facts(spark, d):
    # The searched parameters are valid, and do not fit worse than the start's.
    series = materialize(v.daily(spark, d), "daily")
    fit = fc.fit_holt_winters(series)
    found = fc.holt_winters_state(series, fit).select("entity_id", F.col("sse").alias("found"))
    plain = fc.holt_winters_state(series).select("entity_id", F.col("sse").alias("plain"))
    ranges = fit.select("entity_id", (F.col("alpha").between(0, 1) & F.col("beta").between(0, 1) & F.col("gamma").between(0, 1)).alias("in_range"))
    out = found.join(plain, "entity_id").join(ranges, "entity_id")
    return out.select("entity_id", (F.col("found") <= F.col("plain") * (1 + 1e-9)).alias("not_worse"), "in_range")


@query("iforest_facts", "SELECT count(*) AS n_rows, 0.05::DOUBLE AS flagged_share, 0.0::DOUBLE AS least_score, 1.0::DOUBLE AS greatest_score, true AS extremes_flagged FROM lineitem")
def iforest_facts(spark, d):
    # One row in twenty is flagged, scores fill 0 to 1, and the rows that are extreme in every column are among the flagged.
    lines = materialize(v.sales(spark, d, "l_orderkey", "l_linenumber", "quantity", "unit_price", "total_amount"))
    metrics = ["quantity", "unit_price", "total_amount"]
    far = spark.range(1).select(F.col("id").alias("l_orderkey"), F.lit(-1).alias("l_linenumber"), *[F.lit(1e7).alias(c) for c in metrics])
    rows = materialize(lines.unionByName(far))
    found = ml.forest_detect(rows, ml.fit_forest(rows, ml.fit_scaling(rows, metrics)))
    return found.agg(
        F.count_if(F.col("l_linenumber") >= 0).alias("n_rows"),
        F.round(F.avg(F.col("forest_flag").cast("double")), 2).alias("flagged_share"),
        F.round(F.min("ml_score"), 6).alias("least_score"),
        F.round(F.max("ml_score"), 6).alias("greatest_score"),
        F.bool_and(F.col("forest_flag") | (F.col("l_linenumber") >= 0)).alias("extremes_flagged"),
    )
