"""Structured Streaming forms: chunked CSV ingest, alert suppression, scoring, sliding KPI totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stockflow.operators import anomaly_statistical as stat
from stockflow.operators.alerts import COOLDOWN_MINUTES, HOUR, MAX_PER_HOUR, MINUTE, suppress
from stockflow.plans.kpi import rolling_totals
from stockflow.session import delete, store
from stockflow.sources.files import csv_options


def _at() -> Column:
    """The moment of an alert, in microseconds."""
    return F.unix_micros(F.col("ts").cast("timestamp"))



def csv_chunks(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_chunk: int = 1, delimiter: str = ",") -> DataFrame:
    """Unread files of a folder as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).options(**csv_options(delimiter)).option("maxFilesPerTrigger", files_per_chunk).csv(folder)


def parquet_chunks(spark: SparkSession, folder: str, schema: T.StructType, files_per_chunk: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(folder)


def write_stream(df: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Exactly-once parquet sink that works off everything available and stops."""
    writer = df.writeStream.format("parquet").outputMode(output_mode).option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


class Suppression:
    """The batch suppression on a stream of alerts: rows of (alert_id, rate_key, ts, sent) below ``path``.

    An alert is decided once the watermark (the latest alert time less ``delay``) has passed it, in time order with all
    others of its key, so the order of arrival within ``delay`` changes nothing; alerts older than the watermark are dropped.
    A trigger hands its rows to ``alerts.suppress``: they are sorted by Spark, which may spill, and reduced as they stream
    by, so no task holds a key's rows.  Between triggers a table below ``state`` keeps the undecided alerts and the sends
    that still matter (at most ``max_per_hour`` an hour and key).  Output and state are written by trigger number: a
    repeated trigger overwrites its own rows.  Alerts without a time are dropped.
    """

    def __init__(self, path: str, state: str, cooldown_minutes: float = COOLDOWN_MINUTES, max_per_hour: int = MAX_PER_HOUR, delay_minutes: float = 10):
        self.path, self.state, self.max_per_hour, self.cooldown_minutes = path, state, max_per_hour, cooldown_minutes
        self.delay, self.gap = int(delay_minutes * MINUTE), max(int(cooldown_minutes * MINUTE), HOUR)

    def start(self, alerts: DataFrame) -> StreamingQuery:
        """Work off the alerts that are there, from where the last run stopped."""
        writer = alerts.writeStream.option("checkpointLocation", f"{self.state}/offsets").trigger(availableNow=True)
        return writer.foreachBatch(self._decide).start()

    def close(self, spark: SparkSession) -> None:
        """Decide the alerts that still wait for the watermark.  A stream that goes on decides them anew, with those that came."""
        last = self._last(spark)
        if last is not None:
            self._write(spark.read.parquet(f"{self.state}/trigger={last}/held"), spark.read.parquet(f"{self.state}/trigger={last}/sends"), f"{last}-end")

    def _last(self, spark: SparkSession) -> int | None:
        """The newest trigger whose state is complete."""
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/trigger=*/mark/_SUCCESS")
        found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        return max((int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found or []), default=None)

    def _write(self, rows: DataFrame, sends: DataFrame | None, name: str) -> DataFrame:
        out = f"{self.path}/trigger={name}"
        decided = suppress(rows, self.cooldown_minutes, self.max_per_hour, carried=sends)
        decided.select("alert_id", "rate_key", "ts", "sent").write.mode("overwrite").parquet(out)
        return rows.sparkSession.read.parquet(out)

    def _decide(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = self._last(spark)
        last = number - 1 if last is not None and last >= number else last  # a repeated trigger starts from the one before
        mark, sends, rows = -(2**62), None, batch.filter("ts IS NOT NULL")
        if last is not None and last >= 0:
            kept = f"{self.state}/trigger={last}"
            mark, sends = spark.read.parquet(f"{kept}/mark").first()[0], spark.read.parquet(f"{kept}/sends")
            rows = rows.filter(_at() >= mark).unionByName(spark.read.parquet(f"{kept}/held"))
            delete(spark, f"{self.path}/trigger={last}-end", f"{self.state}/trigger={last - 1}")
        rows = store(rows, "alerts")
        latest = rows.agg(F.max(_at())).first()[0]
        mark = mark if latest is None else max(mark, latest - self.delay)
        fresh = self._write(rows.filter(_at() < mark), sends, str(number)).filter("sent").select("rate_key", _at().alias("t"))
        place = f"{self.state}/trigger={number}"
        fresh = fresh if sends is None else fresh.unionByName(sends)
        fresh.filter(F.col("t") > mark - self.gap).write.mode("overwrite").parquet(f"{place}/sends")
        rows.filter(_at() >= mark).write.mode("overwrite").parquet(f"{place}/held")
        spark.range(1).select(F.lit(mark).cast("bigint").alias("mark")).write.mode("overwrite").parquet(f"{place}/mark")  # last: now it is complete


def score_stream(rows: DataFrame, model: stat.StatModel, method: str = "modified_zscore", threshold: float = 3.0) -> DataFrame:
    """Flag and score stream rows with statistics fitted on history."""
    return stat.detect(rows, model, method, threshold)


def rolling_totals_stream(events: DataFrame, hours: int = 48, delay: str = "1 hour") -> DataFrame:
    """Sliding totals of the last ``hours``, one result per hour."""
    return rolling_totals(events.withWatermark("ts", delay), hours)
