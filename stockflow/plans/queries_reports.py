"""Queries: reports on anomalies and forecasts, records over stock figures, both normality tests, further row rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stockflow.functions.scalars import ADVICE, ratio
from stockflow.operators import anomaly_ensemble as ens
from stockflow.operators import anomaly_statistical as stat
from stockflow.operators import quality as qu
from stockflow.operators import stats as st
from stockflow.plans import kpi
from stockflow.plans import queries_anomaly as qa
from stockflow.plans import queries_forecast as qf
from stockflow.plans import queries_stats as qs
from stockflow.plans import queries_tables as qt
from stockflow.plans import views as v
from stockflow.plans.registry import query
from stockflow.plans.views import sql_with
from stockflow.session import materialize, scratch_path
from stockflow.sources import files, sinks

# ---------------------------------------------------------------- scans


@query("csv_sniffed", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def csv_sniffed(spark, d):
    """A file whose delimiter is found by its first lines."""
    path = scratch_path(spark, "semicolons")
    sinks.write_csv(v.table(spark, d, "orders"), path, delimiter=";")
    orders = files.csv_scan(spark, path, qt.ORDERS_CSV, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], delimiter=None)
    return orders.filter("o_orderstatus <> 'P'")


# ---------------------------------------------------------------- row rules

BACKORDERED = "coalesce(quantity_allocated, 0) - coalesce(quantity_on_hand, 0)"
ALL_QUANTITIES = [*qt.QUANTITIES, "quantity_backordered"]
ALL_STOCK_RULES = {"warehouse_known": "warehouse_location IN ('africa', 'america', 'asia')", **{f"{q}_non_negative": f"{q} >= 0" for q in ALL_QUANTITIES}}


@query(
    "validate_inventory_backorders",
    sql_with("inventory", f"WITH stock AS (SELECT *, {BACKORDERED} AS quantity_backordered FROM inventory) {qt._rule_sql(ALL_STOCK_RULES, 'stock')}"),
)
def validate_inventory_backorders(spark, d):
    stock = v.inventory(spark, d).withColumn("quantity_backordered", F.expr(BACKORDERED))
    return qu.rule_failures(stock, qu.inventory_rules(["africa", "america", "asia"], ALL_QUANTITIES))


DELIVERY_RULES = {**qt.SUPPLIER_RULES, "lead_time_variance_non_negative": "lead_time_variance >= 0", "responsiveness_score_percent": "responsiveness_score BETWEEN 0 AND 100"}


@query(
    "validate_suppliers_scores",
    sql_with(
        "suppliers",
        f"""WITH spread AS (SELECT l_suppkey AS supplier_id, var_samp(date_diff('day', order_date, ship_date)) AS lead_time_variance FROM sales GROUP BY 1),
        scored AS (SELECT *, 100 - 2 * average_lead_time_days AS responsiveness_score FROM suppliers JOIN spread USING (supplier_id)) {qt._rule_sql(DELIVERY_RULES, "scored")}""",
    ),
)
def validate_suppliers_scores(spark, d):
    lag = F.datediff("ship_date", "order_date")
    spread = v.sales(spark, d, "l_suppkey", "order_date", "ship_date").groupBy(F.col("l_suppkey").alias("supplier_id")).agg(F.var_samp(lag).alias("lead_time_variance"))
    scored = v.suppliers(spark, d).join(spread, "supplier_id").withColumn("responsiveness_score", 100 - 2 * F.col("average_lead_time_days"))
    return qu.rule_failures(scored, qu.supplier_rules("all"))


# ---------------------------------------------------------------- records over stock figures

#: Stock figures of a product in a warehouse; more than the five that a record may name.
FIGURES = ["quantity_on_hand", "total_amount", "days_of_supply", "turnover_rate", "quantity", "lines", "discount_amount", "lead_time_days"]

FIGURES_SQL = """figures AS (SELECT product_id || '@' || warehouse_location AS entity_id, max(ship_date) AS seen,
           coalesce(sum(quantity) FILTER (order_status = 'delivered'), 0) AS quantity_on_hand, round(sum(total_amount), 4) AS total_amount,
           round(sum(quantity) FILTER (order_status = 'delivered') / sum(quantity) FILTER (order_status = 'pending') * 30, 6) AS days_of_supply,
           round(sum(quantity) / sum(quantity) FILTER (order_status = 'delivered'), 6) AS turnover_rate, sum(quantity) AS quantity, count(*) AS lines,
           round(sum(discount_amount), 4) AS discount_amount, round(avg(date_diff('day', order_date, ship_date)), 6) AS lead_time_days
         FROM sales WHERE product_id IS NOT NULL AND warehouse_location IS NOT NULL GROUP BY product_id, warehouse_location)"""


def figures(spark, d):
    columns = ["product_id", "warehouse_location", "quantity", "total_amount", "discount_amount", "order_status", "order_date", "ship_date"]
    sales = v.sales(spark, d, *columns).filter("product_id IS NOT NULL AND warehouse_location IS NOT NULL")
    held, asked = (F.sum(F.when(F.col("order_status") == status, F.col("quantity"))) for status in ("delivered", "pending"))
    units = F.sum("quantity")
    grouped = sales.groupBy("product_id", "warehouse_location").agg(
        F.max("ship_date").alias("seen"),
        F.coalesce(held, F.lit(0.0)).alias("quantity_on_hand"),
        F.round(F.sum("total_amount"), 4).alias("total_amount"),
        F.round(ratio(held, asked) * 30, 6).alias("days_of_supply"),
        F.round(ratio(units, held), 6).alias("turnover_rate"),
        units.alias("quantity"),
        F.count(F.lit(1)).alias("lines"),
        F.round(F.sum("discount_amount"), 4).alias("discount_amount"),
        F.round(F.avg(F.datediff("ship_date", "order_date")), 6).alias("lead_time_days"),
    )
    return grouped.select(F.concat_ws("@", F.col("product_id").cast("string"), "warehouse_location").alias("entity_id"), "seen", *FIGURES)


def _advice_sql() -> str:
    cases = " ".join(f"WHEN '{metric}' THEN '{text}'" for metric, text in ADVICE.items())
    return f"CASE top.metric {cases} ELSE 'Investigate the anomaly and review related processes.' END || CASE WHEN severity = 'critical' THEN ' URGENT: Escalate to management immediately.' ELSE '' END"


# High-impact factors count among the five named ones only.
STOCK_RECORDS = f"""{FIGURES_SQL}, {qa._fit_sql(FIGURES, "figures")},
    scored AS (SELECT *, {qa._score_sql(FIGURES)} AS score FROM figures, fit),
    factored AS (SELECT *, list_sort(list_filter([{", ".join(qa._factor_sql(c, i) for i, c in enumerate(FIGURES))}], lambda x: x IS NOT NULL))[1:5] AS f,
        list_sort([{", ".join(f"{{'k': -{qa._capped_sql(qa._mod_z(c))}::DOUBLE, 'i': {i}, 'metric': '{c}', 'actual': {c}::DOUBLE, 'expected': {c}_median::DOUBLE}}" for i, c in enumerate(FIGURES))}])[1] AS top
        FROM scored WHERE score > 0.5),
    graded AS (SELECT *, CASE WHEN score > 0.9 OR list_sum(list_transform(f, lambda x: x.high)) >= 3 THEN 'critical'
        WHEN score > 0.7 OR list_sum(list_transform(f, lambda x: x.high)) >= 1 THEN 'warning' ELSE 'info' END AS severity FROM factored),
    records AS (SELECT top.metric AS metric_name, entity_id, seen AS timestamp, top.actual AS actual_value, top.expected AS expected_value, severity, score AS confidence_score,
        len(f) AS n_factors, array_to_string(list_transform(f, lambda x: x.t), ',') AS factors, {_advice_sql()} AS recommendation FROM graded)"""


def stock_records(spark, d):
    """Records of the statistical detector on stock figures."""
    rows = materialize(figures(spark, d), "figures")
    model = stat.fit_statistics(rows, FIGURES)
    scored = stat.detect(rows, model, flag="stat_flag", score="stat_score")
    scored = ens.ensemble_score(scored, {"statistical": "stat_score"}, rescale=True)
    return ens.anomaly_records(scored, model, "entity_id", "seen", algorithm="ensemble_statistical")


@query(
    "anomaly_records_stock",
    sql_with(
        "sales",
        f"""WITH {STOCK_RECORDS} SELECT metric_name, entity_id, timestamp, actual_value, round(expected_value, 4) AS expected_value, severity,
            round(confidence_score, 6) AS confidence_score, n_factors, factors, recommendation FROM records""",
    ),
)
def anomaly_records_stock(spark, d):
    """Eight figures: a record names the five that deviate most, and gives the advice of its metric."""
    records = stock_records(spark, d).withColumn("n_factors", F.size("contributing_factors").cast("bigint"))
    factors = F.array_join(F.transform("contributing_factors", lambda f: F.concat_ws(":", f["factor"], f["impact"])), ",")
    rounded = [F.round("expected_value", 4).alias("expected_value"), "severity", F.round("confidence_score", 6).alias("confidence_score")]
    return records.select("metric_name", "entity_id", "timestamp", "actual_value", *rounded, "n_factors", factors.alias("factors"), "recommendation")


SPANS = {"24h": "INTERVAL 24 HOUR", "7d": "INTERVAL 7 DAY", "30d": "INTERVAL 30 DAY"}
FILTERED_TO = datetime(2001, 4, 21)


def _filters_sql() -> str:
    """Counts of each time range and metric group that the filter offers, for all three severities."""
    inside = f"timestamp > TIMESTAMP '{FILTERED_TO:%Y-%m-%d}' - {{span}} AND timestamp <= TIMESTAMP '{FILTERED_TO:%Y-%m-%d}'"
    named = {"all": "true", **{g: "metric_name IN (" + ", ".join(f"'{m}'" for m in names) + ")" for g, names in kpi.METRIC_GROUPS.items()}}
    parts = [
        f"SELECT '{r}' AS time_range, '{g}' AS metric_group, severity, metric_name, count(*) AS n FROM records WHERE {inside.format(span=span)} AND {cond} GROUP BY ALL"
        for r, span in SPANS.items() for g, cond in named.items()
    ]
    return sql_with("sales", f"WITH {STOCK_RECORDS} " + " UNION ALL ".join(parts))


@query("anomaly_filter_groups", _filters_sql())
def anomaly_filter_groups(spark, d):
    records = materialize(stock_records(spark, d), "records")
    out = None
    for span in kpi.RANGES:
        for group in ("all", *kpi.METRIC_GROUPS):
            chosen = kpi.filter_anomalies(records, FILTERED_TO, ("critical", "warning", "info"), span, group)
            counts = chosen.groupBy(F.lit(span).alias("time_range"), F.lit(group).alias("metric_group"), "severity", "metric_name").agg(F.count(F.lit(1)).alias("n"))
            out = counts if out is None else out.unionByName(counts)
    return out


# ---------------------------------------------------------------- reports


@query(
    "report_anomaly",
    sql_with(
        "sales",
        f"""WITH {STOCK_RECORDS} SELECT date_trunc('month', timestamp)::DATE AS period_start, metric_name, severity, count(*) AS n, count(DISTINCT entity_id) AS n_entities,
            round(avg(confidence_score), 6) AS mean_confidence, min_by(entity_id, (-round(confidence_score, 9), entity_id)) AS worst_entity FROM records GROUP BY ALL""",
    ),
)
def report_anomaly(spark, d):
    return kpi.anomaly_report(stock_records(spark, d))


@query(
    "report_forecast",
    sql_with(
        "daily",
        f"""{qf.RECORDS} SELECT entity_id, min(ds) AS first_date, max(ds) AS last_date, count(*) AS steps, round(sum(p), 2) AS predicted_total,
            round(sum(p - {qf.Z95} * sd), 2) AS lower_95_total, round(sum(p + {qf.Z95} * sd), 2) AS upper_95_total, any_value(trend_direction) AS trend_direction,
            round(any_value(coalesce(seasonality_strength, 0)), 6) AS seasonality_strength FROM ens JOIN dir USING (entity_id) LEFT JOIN strength USING (entity_id) GROUP BY 1""",
        recursive=True,
    ),
)
def report_forecast(spark, d):
    return kpi.forecast_report(qf._records(qf._series(spark, d)))


@query(
    "stock_heatmap_category",
    sql_with(
        "inventory products",
        "SELECT category, " + ", ".join(f"sum(quantity_on_hand) FILTER (warehouse_location = '{r}') AS \"{r}\"" for r in qt.REGIONS) + " FROM inventory JOIN products USING (product_id) GROUP BY 1",
    ),
)
def stock_heatmap_category(spark, d):
    stock = v.inventory(spark, d).join(v.products(spark, d).select("product_id", "category"), "product_id")
    return kpi.stock_heatmap(stock, qt.REGIONS, "category")


# ---------------------------------------------------------------- normality


K2_PRODUCTS = qs.K2.replace("warehouse_location", "product_id")


@query(
    "normality_verdict",
    sql_with(
        "sales",
        f"""WITH {K2_PRODUCTS}, {qs.shapiro_sql("sales", "product_id", "total_amount")}
        SELECT product_id, CASE WHEN z.n >= 8 THEN round(z1 * z1 + z2 * z2, 4) END AS dagostino_statistic, round(w, 4) AS shapiro_statistic,
            CASE WHEN z.n >= 8 THEN exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AND p > 0.05 END AS is_normal, z.n AS sample_size
        FROM z LEFT JOIN sw USING (product_id)""",
    ),
)
def normality_verdict(spark, d):
    """Both tests on each product's amounts: some thirty values a group, on which the tests disagree at times."""
    both = st.normality_report(v.sales(spark, d, "product_id", "total_amount"), "total_amount", ["product_id"])
    return both.select("product_id", "dagostino_statistic", "shapiro_statistic", "is_normal", "sample_size")
