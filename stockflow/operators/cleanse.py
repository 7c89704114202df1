"""Cleansing: duplicates, names, missing values, outliers, column types.

Steps whose outcome depends on the data (which columns to drop, what to fill with, where to cut)
read one wide aggregate over all columns and then stay lazy.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.scalars import numeric_columns, ratio
from stockflow.operators.ordered import forward_fill
from stockflow.operators.quantiles import exact_quantiles
from stockflow.session import materialize

# Limits and patterns of the cleansing rules.
SPARSE = 0.5  # a column with a larger missing share is dropped
FEW_VALUES = 20  # text columns below this many distinct values are filled with their mode
MIN_DISTINCT = 5  # columns below this many distinct values are never trimmed
IQR_FACTOR = 3.0
Z_LIMIT = 3.0
NUMERIC_TEXT = r"^-?\d+\.?\d*$"
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"
NUMERIC_SHARE = 0.8


@dataclass
class Audit:
    """What a cleansing run did, in order."""

    steps: list[tuple[str, str]] = field(default_factory=list)

    def add(self, step: str, column: str = "") -> None:
        self.steps.append((step, column))

    def frame(self, spark) -> DataFrame:
        rows = [(i, step, column) for i, (step, column) in enumerate(self.steps)]
        return spark.createDataFrame(rows, "step_no INT, step STRING, column_name STRING")


def standard_name(name: str) -> str:
    return re.sub(r"[^a-z0-9_]", "_", name.lower().strip())


def standardize_names(df: DataFrame) -> DataFrame:
    names = [standard_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns share a standardised name: {clashes}")
    return df.toDF(*names)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


@dataclass
class Profile:
    """Row count, missing share and rough distinct count per column, from one aggregate."""

    rows: int
    missing: dict[str, float]
    rough: dict[str, int]


def profile(df: DataFrame) -> Profile:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.col(c)).alias(f"c{i}"), F.approx_count_distinct(F.col(c), 0.05).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    n = row["n"]
    missing = {c: 1 - row[f"c{i}"] / n if n else 0.0 for i, c in enumerate(df.columns)}
    return Profile(n, missing, {c: row[f"d{i}"] for i, c in enumerate(df.columns)})


def missing_shares(df: DataFrame) -> dict[str, float]:
    """Missing share per column, from one aggregate of counts."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: 1 - row[f"c{i}"] / row["n"] if row["n"] else 0.0 for i, c in enumerate(df.columns)}


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text, n) for every distinct non-null value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*").filter("value IS NOT NULL")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _few_values(df: DataFrame, rough: dict[str, int], limit: int) -> dict[str, dict[str, int]]:
    """Value counts of the columns with fewer than ``limit`` distinct values.

    The sketch settles the clear cases; only columns of at most a few hundred values are counted.
    """
    near = [c for c, n in rough.items() if n < 10 * limit]
    if not near:
        return {}
    counts: dict[str, dict[str, int]] = {c: {} for c in near}
    for r in value_counts(df, near).collect():
        counts[r.column_name][r.value] = r.n
    return {c: m for c, m in counts.items() if len(m) < limit}


def _mode(counts: dict[str, int]) -> str:
    """Most frequent value, the smallest among ties."""
    return min(counts, key=lambda value: (-counts[value], value))


def drop_sparse_columns(df: DataFrame, audit: Audit | None = None) -> DataFrame:
    sparse = [c for c, share in missing_shares(df).items() if share > SPARSE]
    for c in sparse:
        if audit:
            audit.add("drop_column", c)
    return df.drop(*sparse)


def fill_missing(
    df: DataFrame, by: Sequence[str] = (), order: Sequence[str] = (), audit: Audit | None = None, known: Profile | None = None
) -> DataFrame:
    """Drop sparse columns, then fill: numbers with the median, times forward, text with mode or 'UNKNOWN'.

    Forward fill needs an explicit row order; without one, times keep their gaps.
    """
    facts = known or profile(df)
    sparse = [c for c, share in facts.missing.items() if share > SPARSE]
    gaps = [c for c, share in facts.missing.items() if 0 < share <= SPARSE]
    out = df.drop(*sparse)
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in gaps if isinstance(types[c], T.NumericType)]
    times = [c for c in gaps if isinstance(types[c], (T.TimestampType, T.TimestampNTZType, T.DateType))]
    texts = [c for c in gaps if isinstance(types[c], (T.StringType, T.BooleanType))]
    fills: dict[str, object] = {}
    if numbers:
        medians = exact_quantiles(out, numbers, [0.5], rows=facts.rows).first()
        fills.update({c: F.lit(medians[c][0]) for c in numbers})
    if texts:
        few = _few_values(out, {c: facts.rough[c] for c in texts}, FEW_VALUES)
        fills.update({c: F.lit(_mode(few[c]) if few.get(c) else "UNKNOWN").cast(types[c]) for c in texts})
    if audit:
        for c in sparse:
            audit.add("drop_column", c)
        for c in numbers:
            audit.add("fill_median", c)
        for c in times if order else []:
            audit.add("fill_forward", c)
        for c in texts:
            audit.add("fill_mode_or_unknown", c)
    if times and order:
        out = forward_fill(out, times, by, order)
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items()}) if fills else out


def _trimmable(df: DataFrame, columns: Sequence[str], facts: Profile) -> list[str]:
    few = _few_values(df, {c: facts.rough[c] for c in columns}, MIN_DISTINCT)
    return [c for c in columns if c not in few]


def _iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float, facts: Profile) -> dict[str, tuple[float, float]]:
    chosen = _trimmable(df, columns, facts)
    if not chosen:
        return {}
    row = exact_quantiles(df, chosen, [0.25, 0.75], rows=facts.rows).first()
    bounds = {}
    for c in chosen:
        if row[c] is not None:
            q1, q3 = row[c]
            bounds[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return bounds


def remove_outliers_iqr(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sequential: bool = False,
    factor: float = IQR_FACTOR,
    audit: Audit | None = None,
    known: Profile | None = None,
) -> DataFrame:
    """Keep rows inside Q1 - 3 IQR .. Q3 + 3 IQR.

    All columns are judged on the input by default (one pass); ``sequential`` judges each column on the
    rows the columns before it left over.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    for group in [[c] for c in columns] if sequential else [columns]:
        facts = known if known and not sequential else profile(df.select(*group))
        for c, (low, high) in _iqr_bounds(df, group, factor, facts).items():
            df = df.filter(F.col(c).between(low, high))
            if audit:
                audit.add("remove_outliers_iqr", c)
    return df


def remove_outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, limit: float = Z_LIMIT) -> DataFrame:
    """Keep rows within ``limit`` population standard deviations; missing values stay."""
    columns = numeric_columns(df) if columns is None else list(columns)
    chosen = _trimmable(df, columns, profile(df.select(*columns)))
    if not chosen:
        return df
    row = df.agg(*[x for c in chosen for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    for c in chosen:
        if row[f"s_{c}"]:
            z = F.abs((F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"])
            df = df.filter(F.col(c).isNull() | (z < limit))
    return df


def repair_types(df: DataFrame, audit: Audit | None = None) -> DataFrame:
    """Turn text columns that hold numbers or dates into such columns; values that do not convert become NULL.

    A column is numeric if more than 80 % of its values look like numbers, a time if any value starts
    with a date.  The whole column is judged.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    looks = [
        part
        for c in texts
        for part in (
            F.avg(F.trim(c).rlike(NUMERIC_TEXT).cast("double")).alias(f"n_{c}"),
            F.max(F.col(c).rlike(DATE_TEXT)).alias(f"d_{c}"),
        )
    ]
    row = df.agg(*looks).first()
    repaired = {}
    for c in texts:
        if (row[f"n_{c}"] or 0) > NUMERIC_SHARE:
            repaired[c] = F.trim(c).try_cast("double")
            step = "convert_numeric"
        elif row[f"d_{c}"]:
            repaired[c] = F.col(c).try_cast("timestamp")
            step = "convert_datetime"
        else:
            continue
        if audit:
            audit.add(step, c)
    return df.withColumns(repaired) if repaired else df


def cleanse(df: DataFrame, by: Sequence[str] = (), order: Sequence[str] = (), compat: bool = False, audit: Audit | None = None) -> DataFrame:
    """The whole chain: duplicates, names, types, missing values, outliers.

    The deduplicated rows are written once, because every later step needs figures from all of them.
    ``compat`` repairs types last and trims column after column, each on what the previous ones left.
    """
    audit = audit or Audit()
    audit.add("remove_duplicates")
    out = materialize(standardize_names(drop_duplicates(df)), "cleanse")
    audit.add("standardize_column_names")
    by, order = [standard_name(c) for c in by], [standard_name(c) for c in order]
    if not compat:
        out = repair_types(out, audit)
    facts = profile(out)
    out = fill_missing(out, by, [c for c in order if c in out.columns], audit, facts)
    # Filling adds at most one value to a column, so the sketch's verdict on distinct values still holds.
    out = remove_outliers_iqr(out, sequential=compat, audit=audit, known=facts)
    return repair_types(out, audit) if compat else out


def column_profile(df: DataFrame) -> DataFrame:
    """One row per number or text column: missing share, distinct values, quartiles, mode."""
    numbers = numeric_columns(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    columns = [c for c in df.columns if c in numbers or c in texts]
    base = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    counts = base.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), F.col(c).alias("n_values")) for c in columns])).alias("p")
    ).select("p.*")
    counted = value_counts(df, columns)
    values = counted.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
    )
    out = counts.join(values, "column_name", "left")
    q = exact_quantiles(df, numbers, [0.25, 0.5, 0.75]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("q")) for c in numbers])).alias("p")
    ).select("p.*")
    out = out.join(q, "column_name", "left")
    return out.select(
        "column_name",
        "n_rows",
        (F.col("n_rows") - F.col("n_values")).alias("missing"),
        ratio(F.col("n_rows") - F.col("n_values"), F.col("n_rows")).alias("missing_share"),
        F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"),
        F.get("q", F.lit(0)).alias("q1"),
        F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("q3"),
        F.when(F.col("column_name").isin(texts), F.col("mode")).alias("mode"),
    )
