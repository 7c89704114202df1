"""Row rules and table-level quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.plans.schemas import CATEGORIES, LOCATIONS, ORDER_STATUSES

Rules = dict[str, Column]  # rule name -> condition a valid row meets


def _non_negative(*names: str) -> Rules:
    return {f"{n}_non_negative": F.col(n) >= 0 for n in names}


def _positive(*names: str) -> Rules:
    return {f"{n}_positive": F.col(n) > 0 for n in names}


def _percent(*names: str) -> Rules:
    return {f"{n}_percent": F.col(n).between(0, 100) for n in names}


def product_rules(categories: Sequence[str] = CATEGORIES) -> Rules:
    return {
        "sku_format": F.col("sku").rlike(r"^[A-Z0-9\-]+$") & F.length("sku").between(3, 50),
        "name_length": F.length("name").between(1, 200),
        "category_known": F.col("category").isin(list(categories)),
        **_positive("unit_price", "unit_cost", "lead_time_days"),
        "price_covers_cost": F.col("unit_price") >= F.col("unit_cost"),
    }


def stock_level_rules() -> Rules:
    """Rules on a product's ordering figures; the weight may be missing."""
    return {
        **_non_negative("minimum_order_quantity", "reorder_point", "safety_stock_level"),
        "weight_kg_positive": F.col("weight_kg").isNull() | (F.col("weight_kg") > 0),
    }


def inventory_rules(locations: Sequence[str] = LOCATIONS, quantities: Sequence[str] = ("quantity_on_hand", "quantity_allocated", "quantity_in_transit")) -> Rules:
    """Rules on a stock row; ``quantities`` may name ``quantity_backordered`` as well."""
    return {"warehouse_known": F.col("warehouse_location").isin(list(locations)), **_non_negative(*quantities)}


def sales_rules(locations: Sequence[str] = LOCATIONS) -> Rules:
    expected = F.col("quantity") * F.col("unit_price") - F.col("discount_amount")
    return {
        **_positive("quantity", "unit_price", "total_amount"),
        **_non_negative("discount_amount"),
        "warehouse_known": F.col("warehouse_location").isin(list(locations)),
        "status_known": F.col("order_status").isin(ORDER_STATUSES),
        "total_matches": F.abs(F.col("total_amount") - expected) <= 0.01,
    }


def currency_rule() -> Rules:
    return {"currency_code": F.length("currency") == 3}


def supplier_rules(scores: str | None = None) -> Rules:
    """Rules on a supplier row; with ``scores="all"`` also on the variance of lead times and on responsiveness."""
    return {
        "name_present": F.length("supplier_name") >= 1,
        **_percent("on_time_delivery_rate", "quality_acceptance_rate", "cost_competitiveness_score"),
        **_non_negative("average_lead_time_days"),
        **_positive("total_orders", "total_value"),
        **({} if scores is None else {**_non_negative("lead_time_variance"), **_percent("responsiveness_score")}),
    }


def anomaly_rules() -> Rules:
    return {"confidence_range": F.col("confidence_score").between(0, 1)}


def forecast_rules() -> Rules:
    return {
        "lower_95_outside": F.col("lower_bound_95") <= F.col("lower_bound_80"),
        "upper_95_outside": F.col("upper_bound_95") >= F.col("upper_bound_80"),
        "inside_80": F.col("predicted_value").between(F.col("lower_bound_80"), F.col("upper_bound_80")),
        "seasonality_range": F.col("seasonality_strength").between(0, 1),
    }


def validate(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``failed_rules``: names of the rules a row breaks.  A missing value breaks its rule."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("failed_rules", F.filter(failed, lambda r: r.isNotNull()))


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return checked.filter(F.size("failed_rules") == 0).drop("failed_rules"), checked.filter(F.size("failed_rules") > 0)


def rule_failures(df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, failed_records) for every rule, in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed_records")) for n in rules])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def quality_checks(df: DataFrame, table_name: str, as_of: Column, completeness: float = 0.9) -> DataFrame:
    """One row per check: duplicates, negative quantities, future dates, completeness.

    Rows are first counted per distinct content (map-side combined), so duplicates come from the same
    aggregate as the other checks.  A check whose column is absent passes.
    """
    cells = len(df.columns)
    filled = sum((F.col(c).isNotNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    negative = F.coalesce(F.col("quantity") < 0, F.lit(True)) if "quantity" in df.columns else F.lit(False)
    future = F.coalesce(F.col("order_date") > as_of, F.lit(True)) if "order_date" in df.columns else F.lit(False)
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    copies = F.col("_copies")
    totals = counted.agg(
        F.sum(copies).alias("total"),
        F.sum(copies - 1).alias("duplicates"),
        F.sum(F.when(negative, copies).otherwise(0)).alias("negatives"),
        F.sum(F.when(future, copies).otherwise(0)).alias("futures"),
        F.sum(copies * (cells - filled)).alias("missing"),
    )
    n = F.col("total")

    def check(name, kind, failed, records, passed=None):
        return F.struct(
            F.lit(name).alias("check_name"),
            F.lit(kind).alias("check_type"),
            (failed == 0 if passed is None else passed).alias("passed"),
            records.alias("total_records"),
            failed.alias("failed_records"),
            (failed / records).alias("failure_rate"),
        )

    missing = F.col("missing")
    rows = F.array(
        check("no_duplicates", "uniqueness", F.col("duplicates"), n),
        check("no_negative_quantities", "validity", F.col("negatives"), n),
        check("no_future_dates", "validity", F.col("futures"), n),
        check("data_completeness", "completeness", missing, n * cells, 1 - missing / (n * cells) > completeness),
    )
    return totals.filter(n > 0).select(F.lit(table_name).alias("table_name"), F.explode(rows).alias("c")).select("table_name", "c.*")


def append_quality_log(checks: DataFrame, path: str, checked_at: Column) -> None:
    """Append the checks, with their counts as a map of details and the time of checking, to a table."""
    counts = ("failed_records", "total_records")
    details = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in counts]))
    checks.withColumns({"details": details, "checked_at": checked_at.cast("timestamp")}).write.mode("append").parquet(path)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent row."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")
