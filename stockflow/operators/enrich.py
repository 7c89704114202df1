"""Derived features: calendar fields, prices, stock and lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.scalars import date_features, ratio
from stockflow.operators.ordered import HOT_ROWS, group_sizes, over_entities, same_keys
from stockflow.session import store

LAGS = (1, 7, 30)


def _dates(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def add_date_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Calendar fields for the given date columns (default: every date or timestamp column)."""
    columns = _dates(df) if columns is None else columns
    features = {name: col for c in columns for name, col in date_features(c).items()}
    return df.withColumns(features) if features else df


def group_means(df: DataFrame, key: str, means: dict[str, str], sizes: tuple[int, int] | None = None) -> DataFrame:
    """Add ``{new: mean of column per key}`` to every row.

    Where ``sizes`` (of ``group_sizes``) are known and no key is hot, the means are a window: the rows move once, and not at all if they are
    partitioned by the key.  Otherwise the means are an aggregate that is written before it is joined back (a NULL key has a mean of its own), not a window.  An
    aggregate that already stands on the join key would leave no exchange between the two, and AQE could not split the join; a
    written one is either small enough to be sent to the rows or joined through exchanges whose hot partitions are split.
    """
    if sizes and sizes[0] <= HOT_ROWS:
        return df.withColumns({new: F.avg(c).over(Window.partitionBy(key)) for new, c in means.items()})
    stats = df.groupBy(key).agg(*[F.avg(c).alias(new) for new, c in means.items()])
    return same_keys(df, store(stats, "means"), [key], "left")


def _with_revenue(df: DataFrame) -> DataFrame:
    return df.withColumns({"revenue": F.col("unit_price") * F.col("quantity"), "transaction_year_month": F.date_format("order_date", "yyyy-MM")})


def _with_price_position(df: DataFrame) -> DataFrame:
    average = F.col("avg_price_by_product")
    return df.withColumn("price_vs_avg", ratio(F.col("unit_price") - average, average) * 100)


def _with_stock_ratios(df: DataFrame) -> DataFrame:
    on_hand, allocated = F.col("quantity_on_hand"), F.col("quantity_allocated")
    return df.withColumns(
        {
            "available_quantity": on_hand - allocated,
            "allocation_rate": ratio(allocated, on_hand),
            "stock_coverage_days": ratio(on_hand, F.col("_mean_quantity")),
        }
    ).drop("_mean_quantity")


PRICE_MEAN = {"avg_price_by_product": "unit_price"}
QUANTITY_MEAN = {"_mean_quantity": "quantity"}


#: Added columns in their order.  They are computed after the rows have moved, and sorted into place at the end.
ADDED = ("revenue", "transaction_year_month", *PRICE_MEAN, "price_vs_avg", "available_quantity", "allocation_rate", "stock_coverage_days")


def _in_order(out: DataFrame, first: Sequence[str]) -> DataFrame:
    names = dict.fromkeys([*first, *(c for c in ADDED if c in out.columns), *out.columns])
    return out.select(*[out[f"`{c}`"] for c in names])


def add_financial_features(df: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``sizes`` of the products, if known (see ``group_means``)."""
    if "product_id" not in df.columns:
        return _with_revenue(df)
    return _in_order(_with_price_position(_with_revenue(group_means(df, "product_id", PRICE_MEAN, sizes))), df.columns)


def add_inventory_features(df: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``sizes`` of the products, if known (see ``group_means``)."""
    return _with_stock_ratios(group_means(df, "product_id", QUANTITY_MEAN, sizes))


def add_lag_features(df: DataFrame, ties: Sequence[str] = (), hot_rows: int = HOT_ROWS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Amount and quantity 1, 7 and 30 rows earlier for the same product.

    ``ties`` names columns that order rows of the same product and date.
    """

    def lags(w):
        return {
            f"{name}_lag_{n}d": F.lag(column, n).over(w)
            for n in LAGS
            for name, column in (("revenue", "total_amount"), ("quantity", "quantity"))
        }

    return over_entities(df, ["product_id"], ["order_date", *ties], lags, lookback=max(LAGS), hot_rows=hot_rows, sizes=sizes)


def calendar_lags(series: DataFrame, days: Sequence[int] = LAGS) -> DataFrame:
    """Values of a daily (entity_id, ds, y, q) series exactly ``days`` calendar days earlier; one shuffle for all of them."""
    w = Window.partitionBy("entity_id").orderBy(F.unix_date("ds"))
    named = (("revenue", "y"), ("quantity", "q"))
    return series.withColumns({f"{name}_lag_{n}d": F.first(c).over(w.rangeBetween(-n, -n)) for n in days for name, c in named})


def enrich(df: DataFrame, ties: Sequence[str] = (), sizes: tuple[int, int] | None = None) -> DataFrame:
    """Every feature group whose inputs are all present; product means come from one aggregate and one join.

    Where the products' ``sizes`` (of ``group_sizes``) are given and none is hot, means and lags are windows over rows that move once.
    """
    present = set(df.columns)
    financial = {"unit_price", "quantity", "order_date"} <= present
    priced = financial and "product_id" in present
    stocked = {"quantity_on_hand", "quantity_allocated", "product_id", "quantity"} <= present
    lagged = {"order_date", "total_amount", "product_id", "quantity"} <= present
    means = {**(PRICE_MEAN if priced else {}), **(QUANTITY_MEAN if stocked else {})}
    steps = [lambda rows: group_means(rows, "product_id", means, sizes)] if means else []
    if lagged:
        measured = sizes or group_sizes(df, ["product_id"])
        # As windows, lags come first: their order serves the means too.
        steps.insert(0 if sizes and sizes[0] <= HOT_ROWS else len(steps), lambda rows: add_lag_features(rows, ties, sizes=measured))
    out = df
    for step in steps:
        out = step(out)
    known = set(out.columns)
    out = add_date_features(out, _dates(df))
    dates = [c for c in out.columns if c not in known]
    if financial:
        out = _with_revenue(out)
    if priced:
        out = _with_price_position(out)
    if stocked:
        out = _with_stock_ratios(out)
    return _in_order(out, [*df.columns, *dates])
