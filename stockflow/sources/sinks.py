"""Table sinks: partitioned parquet, CSV, run log, row counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.plans.schemas import table_schema
from stockflow.sources.files import csv_options


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None, delimiter: str = ",") -> None:
    options = csv_options(delimiter)
    options.pop("mode")
    writer = df.write.mode("overwrite").options(**options)
    (writer.option("compression", compression) if compression else writer).csv(path)


def append_run_log(spark, path: str, entry: dict) -> None:
    """Append one row to the run log."""
    schema = table_schema("etl_logs")
    row = tuple(entry.get(f.name) for f in schema.fields)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) per table."""
    counts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)
