"""Compare a Spark result with a DuckDB result: schema, row count, values (order-insensitive)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(v):
    return "float" if isinstance(v, (float, decimal.Decimal)) else "int" if isinstance(v, int) and not isinstance(v, bool) else type(v).__name__


def _plain(v, digits):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if digits is None else float(f"{v:.{digits}g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x, digits) for x in v)
    return v


def _rows(rows, order, digits):
    return sorted((tuple(_plain(r[i], digits) for i in order) for r in rows), key=repr)


SAME = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "FLOAT": "float",
    "TIMESTAMP": "timestamp", "HUGEINT": "hugeint", "SMALLINT": "smallint",
}


def compare(spark_df: DataFrame, con, sql: str) -> tuple[bool, str]:
    """(values equal to the last digit, message); an empty message means equal in every respect."""
    left = spark_df.collect()
    rel = con.sql(sql)
    names, right = rel.columns, rel.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} <> {sorted(names)}"
    kinds = dict(zip(names, map(str, rel.types)))
    types = []
    for c in sorted(names):
        spark_type = spark_df.schema[c].dataType.simpleString().replace("timestamp_ntz", "timestamp")
        if SAME.get(kinds[c], spark_type) != spark_type:
            types.append(f"{c}: {spark_type} <> {kinds[c]}")
    lo, ro = [spark_df.columns.index(c) for c in sorted(names)], [names.index(c) for c in sorted(names)]
    note = f" types {types}" if types else ""
    if len(left) != len(right):
        return False, f"rows {len(left)} <> {len(right)}{note}"
    if _rows(left, lo, None) == _rows(right, ro, None):
        return True, note
    for digits in (12, 9, 6):
        if _rows(left, lo, digits) == _rows(right, ro, digits):
            return False, f"equal to {digits} digits only{note}"
    a, b = _rows(left, lo, 9), _rows(right, ro, 9)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return False, f"values differ in {len(diff)} rows, e.g. {diff[0]}{note}"
