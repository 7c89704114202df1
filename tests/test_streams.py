import datetime as dt

from pyspark.sql import functions as F

from stockflow.operators import anomaly_statistical as stat
from stockflow.plans import kpi
from stockflow.plans import views as v
from stockflow.session import scratch_path
from stockflow.sources import sinks
from stockflow.streaming import jobs


def _land(events, hours, spark):
    """Files in time order, one per chunk."""
    folder = scratch_path(spark, "land")
    first = events.agg(F.min("ts")).first()[0].replace(minute=0, second=0, microsecond=0)
    for i in range(hours):
        low, high = (F.lit(first + dt.timedelta(days=8 * (i + k))) for k in (0, 1))
        events.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_csv_chunks(spark, sf):
    region = v.table(spark, sf, "nation")
    folder, out = scratch_path(spark, "csv"), scratch_path(spark, "out")
    sinks.write_csv(region.repartition(3), folder)
    query = jobs.write_stream(jobs.csv_chunks(spark, folder, region.schema), f"{out}/data", f"{out}/state")
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 3
    assert sorted(map(tuple, spark.read.parquet(f"{out}/data").collect())) == sorted(map(tuple, region.collect()))


def test_sliding_totals_on_a_stream(spark, sf):
    """Windows the watermark has closed equal the batch result."""
    events = v.table(spark, sf, "events").select("ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "out")
    stream = jobs.rolling_totals_stream(jobs.parquet_chunks(spark, _land(events, 4, spark), events.schema))
    jobs.write_stream(stream, f"{out}/data", f"{out}/state").awaitTermination()
    done = {tuple(r) for r in spark.read.parquet(f"{out}/data").collect()}
    batch = {tuple(r) for r in kpi.rolling_totals(events).collect()}
    assert done <= batch and len(done) > 0.8 * len(batch)


def test_scored_stream_equals_batch(spark, sf):
    events = v.table(spark, sf, "events").select("event_id", "ts", "value")
    model = stat.fit_statistics(events, ["value"])
    out = scratch_path(spark, "out")
    stream = jobs.score_stream(jobs.parquet_chunks(spark, _land(events, 4, spark), events.schema), model)
    jobs.write_stream(stream, f"{out}/data", f"{out}/state").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/data").collect())) == sorted(map(tuple, stat.detect(events, model).collect()))
