"""KPI and report queries over the domain views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.scalars import ratio
from stockflow.operators.aggregate import aggregate

# Metrics behind each choice of the anomaly filter.
METRIC_GROUPS = {
    "sales": ["total_amount", "quantity", "unit_price", "revenue"],
    "inventory": ["quantity_on_hand", "quantity_allocated", "quantity_in_transit", "days_of_supply", "turnover_rate"],
    "delivery": ["lead_time_days", "on_time_delivery_rate", "average_lead_time_days"],
}
RANGES = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}


def overview(sales: DataFrame, on_time_days: int = 60) -> DataFrame:
    """Orders, revenue, units per order and on-time share per month, each against the month before.

    A shipped line is on time when it left within ``on_time_days`` of its order.  One row per month, so
    the unpartitioned window runs over a calendar-bounded table.
    """
    # Lines are reduced to orders first: one row per order, whatever its number of lines.
    on_time = F.datediff("ship_date", "order_date") <= on_time_days
    orders = sales.groupBy(F.date_format("order_date", "yyyy-MM").alias("month"), "l_orderkey").agg(
        F.sum("total_amount").alias("amount"), F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("lines"), F.count_if(on_time).alias("on_time")
    )
    months = orders.groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"),
        F.round(F.sum("amount"), 4).alias("revenue"),
        F.sum("units").alias("units"),
        (F.sum("on_time") / F.sum("lines")).alias("on_time_share"),
    )
    w = Window.orderBy("month")
    return months.select(
        "*",
        *[F.round(ratio(F.col(c) - F.lag(c).over(w), F.lag(c).over(w)) * 100, 4).alias(f"{c}_change_pct") for c in ("orders", "revenue", "on_time_share")],
    )


def turnover(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Units sold per month against the stock on hand, by the year, and the change to the month before (one row per month)."""
    on_hand = inventory.agg(F.sum("quantity_on_hand")).first()[0]
    months = sales.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.sum("quantity").alias("units"))
    rate = ratio(F.col("units") * 12, F.lit(on_hand))
    before = F.lag("_rate").over(Window.orderBy("month"))
    return months.withColumn("_rate", rate).select("month", "units", F.round("_rate", 6).alias("turnover"), F.round(F.col("_rate") - before, 6).alias("turnover_change"))


def revenue_trend(daily: DataFrame, window: int = 7) -> DataFrame:
    """Daily revenue per warehouse with its average over ``window`` recorded days (NULL until the window is full)."""
    frame = Window.partitionBy("entity_id").orderBy("ds").rowsBetween(-(window - 1), 0)
    full = F.count("y").over(frame) == window
    return daily.select("entity_id", "ds", F.col("y").alias("revenue"), F.round(F.when(full, F.avg("y").over(frame)), 4).alias("moving_average"))


def status_mix(sales: DataFrame) -> DataFrame:
    """Lines and share per order status."""
    counts = sales.groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("order_status", "n", (F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share_pct"))


def stock_by_warehouse(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("warehouse_location").agg(
        F.sum("quantity_on_hand").alias("on_hand"), F.sum("quantity_allocated").alias("allocated"), F.count(F.lit(1)).alias("n_items")
    )


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """Best sellers; a top-k per task, no full sort."""
    totals = sales.groupBy("product_id").agg(F.round(F.sum("total_amount"), 4).alias("revenue"))
    return totals.orderBy(F.col("revenue").desc(), "product_id").limit(n)


def recent_anomalies(records: DataFrame, n: int = 10) -> DataFrame:
    status = F.when(F.col("is_resolved"), "resolved").when(F.col("is_acknowledged"), "acknowledged").otherwise("open")
    newest = records.orderBy(F.col("timestamp").desc(), F.col("confidence_score").desc(), "entity_id", "actual_value").limit(n)
    return newest.select("timestamp", F.col("metric_name").alias("metric"), "entity_id", F.upper("severity").alias("severity"), F.round("deviation_percentage", 2).alias("deviation"), status.alias("status"))


def filter_anomalies(records: DataFrame, as_of: datetime, severities: Sequence[str] = ("critical", "warning"), time_range: str = "24h", group: str = "all") -> DataFrame:
    """Records of the chosen severities and metric group in the time range that ends at ``as_of``."""
    since = as_of - RANGES[time_range]
    out = records.filter(F.col("severity").isin(list(severities)) & (F.col("timestamp") > F.lit(since)) & (F.col("timestamp") <= F.lit(as_of)))
    return out if group == "all" else out.filter(F.col("metric_name").isin(METRIC_GROUPS[group]))


def anomaly_timeline(records: DataFrame, unit: str = "day") -> DataFrame:
    return records.groupBy(F.to_date(F.date_trunc(unit, "timestamp")).alias("ds"), "severity").agg(F.count(F.lit(1)).alias("n"))


def forecast_view(series: DataFrame, records: DataFrame, confidence: int = 95) -> DataFrame:
    """History and forecast in one table, with the bounds of the chosen confidence."""
    history = series.select(
        F.col("entity_id").cast("string").alias("entity_id"), F.lit("history").alias("kind"), "ds", F.col("y").alias("value"),
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
    )
    path = records.select(
        "entity_id", F.lit("forecast").alias("kind"), F.col("forecast_date").alias("ds"), F.col("predicted_value").alias("value"),
        F.col(f"lower_bound_{confidence}").alias("lower"), F.col(f"upper_bound_{confidence}").alias("upper"),
    )
    return history.unionByName(path)


def stock_heatmap(inventory: DataFrame, locations: Sequence[str], by: str = "product_id") -> DataFrame:
    """Stock on hand per product (or category) with one column per warehouse."""
    return inventory.groupBy(by).pivot("warehouse_location", list(locations)).agg(F.sum("quantity_on_hand"))


def anomaly_report(records: DataFrame, unit: str = "month") -> DataFrame:
    """Records, entities, mean confidence and the worst entity of each period, metric and severity."""
    worst = F.struct(-F.round("confidence_score", 9), F.col("entity_id"))
    return records.groupBy(F.to_date(F.date_trunc(unit, "timestamp")).alias("period_start"), "metric_name", "severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("entity_id").alias("n_entities"),
        F.round(F.avg("confidence_score"), 6).alias("mean_confidence"),
        F.min_by("entity_id", worst).alias("worst_entity"),
    )


def forecast_report(records: DataFrame) -> DataFrame:
    """Span, totals with their 95 % bounds, direction and weekly pattern of each entity's forecast."""
    totals = {"predicted_value": "predicted_total", "lower_bound_95": "lower_95_total", "upper_bound_95": "upper_95_total"}
    return records.groupBy("entity_id").agg(
        F.min("forecast_date").alias("first_date"),
        F.max("forecast_date").alias("last_date"),
        F.count(F.lit(1)).alias("steps"),
        *[F.round(F.sum(c), 2).alias(name) for c, name in totals.items()],
        F.first("trend_direction").alias("trend_direction"),
        F.round(F.first("seasonality_strength"), 6).alias("seasonality_strength"),
    )


def periodic_report(sales: DataFrame, freq: str = "M") -> DataFrame:
    """Lines, units and revenue per warehouse and day ('D'), week ('W') or month ('M'), gaps filled with 0."""
    agg = {"total_amount": ["sum", "count"], "quantity": ["sum"]}
    report = aggregate(sales, ["warehouse_location"], agg, freq)
    return report.select(
        "warehouse_location", F.col("order_date").alias("period_end"), F.col("total_amount_count").alias("lines"),
        F.col("quantity_sum").alias("units"), F.round("total_amount_sum", 4).alias("revenue"),
    )


def rolling_totals(events: DataFrame, hours: int = 48, slide_hours: int = 1, ts: str = "ts", value: str = "value") -> DataFrame:
    """Sliding event-time windows: events and value per type; works on a batch and on a watermarked stream.

    Events are first summed per slide, so only those sums are copied into the overlapping windows.
    """
    each = events.groupBy(F.window(ts, f"{slide_hours} hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    spans = F.window("w", f"{hours} hours", f"{slide_hours} hour").alias("span")
    totals = each.groupBy(spans, "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return totals.select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "event_type", "n", F.round("total", 4).alias("total"))
