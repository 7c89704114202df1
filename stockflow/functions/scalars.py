"""Column expressions of the domain model.  All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Standard normal quantiles for two-sided 80 % and 95 % bounds.
Z80 = 1.2815515655446004
Z95 = 1.959963984540054
TINY = 1e-10  # stands in for a zero spread


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns (booleans are not numeric)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def correlation(x, y) -> Column:
    """Pearson coefficient over complete pairs; NULL for a constant side, where ``corr`` would raise."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def date_features(date_col: str) -> dict[str, Column]:
    """Calendar fields of a date column; weeks are ISO, Monday is day 0."""
    d, prefix = F.col(date_col), date_col.replace("_date", "")
    day = F.to_date(d)
    return {
        f"{prefix}_year": F.year(d),
        f"{prefix}_month": F.month(d),
        f"{prefix}_quarter": F.quarter(d),
        f"{prefix}_day_of_week": F.weekday(d),
        f"{prefix}_day_of_month": F.dayofmonth(d),
        f"{prefix}_week_of_year": F.weekofyear(d),
        f"{prefix}_is_weekend": (F.weekday(d) >= 5).cast("int"),
        f"{prefix}_is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        f"{prefix}_is_month_end": (day == F.last_day(d)).cast("int"),
    }


def margin_pct(price, cost) -> Column:
    """Margin as a percentage of the price; 0 without a positive price."""
    return F.when(price > 0, ratio(price - cost, price) * 100).otherwise(F.lit(0.0))


def stockout_risk(days_of_supply) -> Column:
    """1 with no days of supply left, 0 from 30 days on, 0.5 when unknown."""
    linear = 1 - days_of_supply / 30
    return F.when(days_of_supply.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear)))


def supplier_score(on_time, quality, lead_days, cost, responsiveness) -> Column:
    """Weighted supplier score, rounded to 2 decimals."""
    speed = F.greatest(F.lit(0.0), 100 - lead_days * 5)
    return F.round(on_time * 0.30 + quality * 0.25 + speed * 0.20 + cost * 0.15 + responsiveness * 0.10, 2)


def _ladder(value, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower limit ``value`` reaches."""
    out = None
    for limit, label in steps:
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return out.otherwise(otherwise)


def correlation_strength(r) -> Column:
    return F.when(r.isNotNull(), _ladder(F.abs(r), [(0.8, "very_strong"), (0.6, "strong"), (0.4, "moderate"), (0.2, "weak")], "very_weak"))


def skewness_label(skew) -> Column:
    side = F.when(skew > 0, "right_skewed").otherwise("left_skewed")
    return (
        F.when(F.abs(skew) < 0.5, "approximately_symmetric")
        .when(F.abs(skew) < 1, side)
        .otherwise(F.concat(F.lit("highly_"), side))
    )


def severity(score, factors) -> Column:
    """Severity from the ensemble score and the number of high-impact factors."""
    high = F.size(F.filter(factors, lambda f: f["impact"] == "high"))
    return F.when((score > 0.9) | (high >= 3), "critical").when((score > 0.7) | (high >= 1), "warning").otherwise("info")


# Advice texts per metric, the default, and the suffix for critical anomalies.
ADVICE = {
    "quantity_on_hand": "Review inventory levels and consider reorder. Check supplier lead times.",
    "total_amount": "Investigate unusual transaction amounts. Verify pricing and discounts.",
    "days_of_supply": "Analyze demand forecast accuracy. Adjust safety stock levels.",
    "turnover_rate": "Review product movement patterns. Consider promotional strategies.",
}
DEFAULT_ADVICE = "Investigate the anomaly and review related processes."
URGENT = " URGENT: Escalate to management immediately."


def recommendation(metric, level) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    base = F.coalesce(F.try_element_at(lookup, metric), F.lit(DEFAULT_ADVICE))
    return F.concat(base, F.when(level == "critical", URGENT).otherwise(""))


def alert_channels(level) -> Column:
    """Critical and emergency alerts go to e-mail and chat, the others to chat only."""
    return F.when(level.isin("critical", "emergency"), F.array(F.lit("email"), F.lit("slack"))).otherwise(F.array(F.lit("slack")))


def change(current, previous) -> dict[str, Column]:
    """Percentage change and its direction."""
    pct = ratio(current - previous, previous) * 100
    direction = F.when(current > previous, "up").when(current < previous, "down").when(current == previous, "stable")
    return {"change_percentage": pct, "change_direction": direction}


def metric_status(value, warning, critical) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("normal")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
