import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.operators import alerts as al
from stockflow.plans.queries_alerts import landed
from stockflow.session import scratch_path
from stockflow.streaming import jobs

START = dt.datetime(2024, 1, 1)
SCHEMA = "alert_id long, title string, severity string, ts timestamp, dedup_key string"


def _alerts(spark, minutes, dedup=None, title="t"):
    return spark.createDataFrame([(i, title, "warning", START + dt.timedelta(minutes=m), dedup) for i, m in enumerate(minutes)], SCHEMA)


def _sent(df):
    seconds = [(r.ts - START).total_seconds() for r in df.filter("sent").orderBy("ts", "alert_id").collect()]
    return [s / 60 for s in seconds]


@pytest.mark.parametrize(
    "minutes, dedup, options, sent",
    [
        ([0, 5, 14, 15, 29, 30, 45, 60], None, {}, [0, 15, 30, 45, 60]),
        ([0, 20, 59, 60, 100], "k", {}, [0, 60]),
        ([0, 1, 2, 3, 59, 60], None, {"cooldown_minutes": 0, "max_per_hour": 3}, [0, 1, 2, 60]),
        ([0, 1], "", {}, [0]),
        ([0, 61, 500], None, {"cooldown_minutes": 120}, [0, 500]),
        ([0, 0, 30], None, {"max_per_hour": 0}, []),
    ],
)
def test_rules(spark, minutes, dedup, options, sent):
    assert _sent(al.suppress(_alerts(spark, minutes, dedup), **options)) == sent


def test_keys_are_independent(spark):
    both = _alerts(spark, [0, 5], title="a").unionByName(_alerts(spark, [1, 6], title="b").withColumn("alert_id", F.col("alert_id") + 10))
    assert _sent(al.suppress(both)) == [0, 1]
    assert {r.rate_key for r in al.suppress(both).collect()} == {"a_warning", "b_warning"}


def test_undelivered_alerts_leave_no_state(spark):
    df = _alerts(spark, [0, 5, 10]).withColumn("delivered", F.col("alert_id") > 0)
    assert _sent(al.suppress(df)) == [5]


@pytest.fixture(scope="module")
def busy(spark):
    """A hot key with an alert every few seconds for days without a gap, and some quiet keys."""
    second = F.col("id") * 37 + F.pmod(F.xxhash64("id"), F.lit(23))
    hot = spark.range(6000).select("id", second.alias("s"), F.lit("hot").alias("title"), F.when(F.col("id") % 1 == 1, "x").alias("dedup_key"))
    quiet = spark.range(6000, 6400).select("id", (F.pmod(F.xxhash64("id"), F.lit(220000))).alias("s"), F.concat(F.lit("q"), F.col("id") % 5).alias("title"), F.concat(F.lit("d"), F.col("id") % 5).alias("dedup_key"))
    rows = hot.unionByName(quiet)
    return rows.select(
        F.col("id").alias("alert_id"), "title", F.lit("info").alias("severity"), F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"), "dedup_key"
    ).checkpoint()


def _brute(rows, cooldown, cap):
    """Alert by alert, with the whole list of sends."""
    sent, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.alert_id is not None, r.alert_id or 0)):
        now, key = r.ts.timestamp() / 60, r.dedup_key or f"{r.title}_{r.severity}"
        before = sent.setdefault(key, [])
        ok = cap > 0 and (not before or now - before[-1] >= (max(cooldown, 60) if r.dedup_key else cooldown)) and sum(now - t < 60 for t in before) < cap
        if ok:
            before.append(now)
        out[r.alert_id] = ok
    return out


@pytest.mark.parametrize("cooldown, cap", [(15, 20), (1, 20), (0, 3), (2.5, 7), (90, 1)])
def test_long_sessions(busy, cooldown, cap):
    expected = _brute(busy.collect(), cooldown, cap)
    for hot in (500, 10**9):
        assert {r.alert_id: r.sent for r in al.suppress(busy, cooldown, cap, hot_rows=hot).collect()} == expected
    assert any(expected.values())


def test_null_ids_and_mixed_keys(spark):
    rows = [(None, "t", "info", START, "k"), (None, "t", "info", START, None), (1, "k", "x", START + dt.timedelta(minutes=1), "k")]
    out = al.suppress(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 3 and [r.sent for r in out.orderBy("ts", "rate_key").collect()] == [True, True, False]


def test_stream_equals_batch(spark, busy):
    """Stopped and started again, with rows up to five minutes late and an end that proves not to be the last."""
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    job = jobs.Suppression(f"{out}/data", f"{out}/state")
    for step in landed(busy, folder, 3):
        job.start(jobs.parquet_chunks(spark, folder, busy.schema, 1000)).awaitTermination()
        if step != 1:
            job.close(spark)
    rows = [(r.alert_id, r.sent) for r in spark.read.parquet(f"{out}/data").collect()]
    assert dict(rows) == {r.alert_id: r.sent for r in al.suppress(busy).collect()} and len(rows) == busy.count()


def test_stream_drops_what_the_watermark_has_passed(spark):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    job = jobs.Suppression(f"{out}/data", f"{out}/state", delay_minutes=5)
    for minutes in ([0, 30], [24, 26, 60]):  # the second landing is read when 25 minutes have been passed
        rows = [(m, "t", "info", START + dt.timedelta(minutes=m), None) for m in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        job.start(jobs.parquet_chunks(spark, folder, T.StructType.fromDDL(SCHEMA), 1000)).awaitTermination()
    decided = {r.alert_id: r.sent for r in spark.read.parquet(f"{out}/data").collect()}
    assert decided == {0: True, 26: True, 30: False}
    job._decide(spark.createDataFrame([(24, "t", "info", START + dt.timedelta(minutes=24), None), (26, "t", "info", START + dt.timedelta(minutes=26), None),
                                       (60, "t", "info", START + dt.timedelta(minutes=60), None)], SCHEMA), 1)
    assert {r.alert_id: r.sent for r in spark.read.parquet(f"{out}/data").collect()} == decided
    job.close(spark)
    assert {r.alert_id: r.sent for r in spark.read.parquet(f"{out}/data").collect()} == {**decided, 60: True}


def test_routing(spark):
    df = spark.createDataFrame(
        [(0, "info", None), (1, "critical", None), (2, "emergency", None), (3, "critical", ["slack", "pager"]), (4, "info", ["pager"])], "i int, severity string, wish array<string>"
    )
    rows = {r.i: r.channels for r in al.route(df, explicit="wish").collect()}
    assert rows == {0: ["slack"], 1: ["email", "slack"], 2: ["email", "slack"], 3: ["slack"], 4: []}


def test_health_and_history(spark):
    status = spark.createDataFrame([("db", "healthy", START), ("db", "down", START)], "component string, status string, ts timestamp")
    rows = al.health_alerts(status).orderBy("severity").collect()
    assert [(r.severity, r.message, r.dedup_key) for r in rows] == [("critical", "Component 'db' is down.", "health_db"), ("info", "Component 'db' is healthy.", "health_db")]
    sent = al.route(_alerts(spark, range(5)).withColumn("severity", F.when(F.col("alert_id") < 2, "critical").otherwise("info")))
    assert [r.alert_id for r in al.alert_history(sent, 2).collect()] == [4, 3]
    assert [r.alert_id for r in al.alert_history(sent, severity="critical").collect()] == [1, 0]
    stats = {(r.dimension, r.value): r.n for r in al.alert_stats(sent).collect()}
    assert stats == {("total", "all"): 5, ("severity", "critical"): 2, ("severity", "info"): 3, ("channel", "email"): 2, ("channel", "slack"): 5, ("last_alert", "alert_id"): 4}
