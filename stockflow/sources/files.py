"""CSV files, landed JSON pages, parameterised SQL, several sources together."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.scalars import nan_to_null
from stockflow.operators.ordered import same_keys

SNIFF_CHARS = 8192
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def csv_options(delimiter: str = ",") -> dict[str, str]:
    """Reader options shared by batch and stream.  ``.gz`` files are recognised by their suffix."""
    return {"header": "true", "sep": delimiter, "encoding": "UTF-8", "mode": "PERMISSIVE", "timestampFormat": TIMESTAMP_FORMAT, "quote": '"', "escape": '"'}


def infer_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter guessed from the first lines of a file (a read of a few kilobytes)."""
    lines = spark.read.text(path).select(F.substring("value", 1, SNIFF_CHARS).alias("value")).limit(50).collect()
    head = "\n".join(r.value for r in lines)[:SNIFF_CHARS]
    return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter


def csv_scan(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    filters: dict | None = None,
    delimiter: str | None = ",",
    multi_line: bool = False,
    bad_rows: str | None = None,
) -> DataFrame:
    """Rows of CSV files with a header; projection and equality filters reach the scan.

    Quotes inside quoted cells are doubled.  ``multi_line`` allows line breaks in quoted cells; a file is then one split.
    Without a schema the types are inferred, which costs an extra pass; without a delimiter it is guessed from the first file's
    head.  ``bad_rows`` (with a schema) adds a column of that name with the text of each row that has a cell of another type or a wrong
    number of cells, NULL for good rows; ``count_bad_rows`` counts them.  An unknown column raises.
    """
    if delimiter is None:
        delimiter = infer_delimiter(spark, path if isinstance(path, str) else path[0])
    reader = spark.read.options(**csv_options(delimiter)).option("multiLine", str(multi_line).lower())
    if schema is not None and bad_rows:
        schema = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, T.StructField(bad_rows, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", bad_rows)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])  # a byte order mark sticks to the first inferred name
    unknown = [c for c in [*(columns or []), *(filters or {})] if c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {unknown}")
    if filters:
        df = df.filter(reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in filters.items()]))
    return nan_to_null(df.select(*columns, *([bad_rows] if bad_rows and bad_rows not in columns else [])) if columns else df)


def count_bad_rows(df: DataFrame, bad_rows: str) -> DataFrame:
    """(records, bad_records) of a scan with a column of bad rows."""
    # The cells must be read for a row to be found bad.
    read = F.xxhash64(*[c for c in df.columns if c != bad_rows]) >= F.lit(-(2**63))
    return df.agg(F.count_if(read).alias("records"), F.count_if(read & F.col(bad_rows).isNotNull()).alias("bad_records"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed response bodies, one file per page, as (page, body); the page number is the last number in the file name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("body"))
    return files.select(F.regexp_extract("name", r"(\d+)\D*$", 1).cast("bigint").alias("page"), "body")


def _parsed_pages(pages: DataFrame, row_schema: str) -> DataFrame:
    envelope = f"results ARRAY<STRUCT<{row_schema}>>, data ARRAY<STRUCT<{row_schema}>>, has_next BOOLEAN, next STRING"
    is_list = F.ltrim("body").startswith("[")
    return pages.withColumns(
        {
            "_list": F.when(is_list, F.from_json("body", f"ARRAY<STRUCT<{row_schema}>>")),
            "_object": F.when(~is_list, F.from_json("body", envelope)),
        }
    ).withColumns(
        {
            "_rows": F.coalesce("_list", "_object.results", "_object.data"),
            "_more": F.coalesce(F.coalesce(F.col("_object.has_next"), F.col("_object.next").isNotNull()), F.lit(False)),
        }
    )


def unreadable_pages(pages: DataFrame, row_schema: str, by: Sequence[str] = ()) -> DataFrame:
    """(``by``..., page, error) of pages whose body holds no list of rows."""
    text = F.when(F.col("body").isNull(), "no body").otherwise(F.concat(F.lit("unreadable body: "), F.substring("body", 1, 80)))
    return _parsed_pages(pages, row_schema).filter("_rows IS NULL").select(*by, "page", text.alias("error"))


def json_pages(pages: DataFrame, row_schema: str, by: Sequence[str] = (), max_pages: int | None = None) -> DataFrame:
    """Rows of paged responses (``by``..., page, body) up to the first page that has no more.

    A body is a list (then it is the last page) or an object with rows under ``results`` or ``data`` and
    the flag ``has_next`` or a non-null ``next``.  An empty or unreadable page ends its source (``unreadable_pages`` reports the
    latter).  ``max_pages`` is a number of pages of each source, whatever their numbering.
    """
    parsed = _parsed_pages(pages, row_schema)
    filled = F.coalesce(F.size("_rows") > 0, F.lit(False))
    numbers = F.sort_array(F.collect_set("page"))  # of one source's pages
    last = F.lit(None).cast("bigint") if max_pages is None else F.coalesce(F.get(numbers, F.lit(max_pages - 1)), F.max("page")) if max_pages > 0 else F.min("page") - 1
    ends = parsed.groupBy(*by).agg(F.min(F.when(~filled | ~F.col("_more"), F.col("page"))).alias("_end"), last.alias("_last"))
    if by:
        kept = same_keys(parsed, ends, list(by), "left")
        limits = [F.col("_end"), F.col("_last")]
    else:
        found = ends.first()
        kept, limits = parsed, [F.lit(found["_end"]).cast("bigint"), F.lit(found["_last"]).cast("bigint")]
    for limit in limits:
        kept = kept.filter(limit.isNull() | (F.col("page") <= limit))
    return kept.select(*by, "page", F.explode("_rows").alias("_row")).select(*by, "page", "_row.*")


def sql_scan(spark: SparkSession, query: str, params: dict | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Result of a SQL text with named ``:parameters``; an empty result keeps its columns."""
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    return nan_to_null(spark.sql(query, args=params or {}))


def jdbc_scan(spark: SparkSession, url: str, table: str, partition_column: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """Table of an external database, read in parallel over ranges of a numeric column."""
    low, high = bounds
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options)
        .load()
    )


def multi_source(
    spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], schemas: dict[str, T.StructType | str] | None = None
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Load several named sources; one that cannot be planned becomes an empty frame of its declared schema.

    Returns the frames and the error text per failed source.
    """
    frames, errors = {}, {}
    for name, load in loaders.items():
        try:
            frames[name] = load()
        except Exception as error:  # a missing path or table must not stop the other sources
            errors[name] = str(error).splitlines()[0]
            frames[name] = spark.createDataFrame([], (schemas or {}).get(name, T.StructType()))
    return frames, errors


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources stacked by column name, with ``source``; absent columns are NULL."""
    tagged = [f.withColumn("source", F.lit(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds its row count once an action has run."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("records_extracted")), watch


def scan_metrics(df: DataFrame, bad_rows: str | None = None) -> DataFrame:
    """(records_extracted, files, bytes_processed, errors, elapsed_seconds) of a file-based frame; it is read once, here."""
    began = time.monotonic()
    errors = F.lit(0).cast("bigint") if bad_rows is None else F.count(bad_rows)
    files = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"), errors.alias("bad"))
    totals = files.agg(F.sum("n").alias("records_extracted"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes_processed"), F.sum("bad").alias("errors"))
    schema, row = totals.schema, totals.first()
    found = df.sparkSession.createDataFrame([tuple(row)], schema)
    return found.withColumn("elapsed_seconds", F.lit(time.monotonic() - began))
