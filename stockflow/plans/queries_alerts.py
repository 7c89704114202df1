"""Queries: alert suppression in batch and stream, routing, messages, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.operators import alerts as al
from stockflow.plans import queries_anomaly as qa
from stockflow.plans import views as v
from stockflow.plans.registry import query
from stockflow.plans.views import sql_with
from stockflow.session import scratch_path
from stockflow.streaming import jobs

# An alert goes out if it is the next one of its key at least an hour (deduplicated) or 15 minutes after the last that did.
CHAIN = """first AS (SELECT rate_key, ts, min(alert_id) AS alert_id, max(CASE WHEN dedup_key IS NULL THEN INTERVAL 15 MINUTE ELSE INTERVAL 60 MINUTE END) AS hold FROM alerts GROUP BY 1, 2),
       moments AS (SELECT rate_key, ts AS moment, ts AS event, NULL::TIMESTAMP AS src FROM first UNION ALL SELECT rate_key, ts + hold, NULL, ts FROM first),
       links AS (SELECT rate_key, src AS ts, nxt FROM (SELECT *, min(event) OVER (PARTITION BY rate_key ORDER BY moment RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM moments)
                 WHERE src IS NOT NULL AND nxt IS NOT NULL),
       chain AS (SELECT rate_key, min(ts) AS ts FROM first GROUP BY 1 UNION ALL SELECT l.rate_key, l.nxt FROM chain c JOIN links l ON c.rate_key = l.rate_key AND c.ts = l.ts),
       decided AS (SELECT a.*, f.alert_id IS NOT NULL AS sent FROM alerts a LEFT JOIN (SELECT first.* FROM first JOIN chain USING (rate_key, ts)) f ON a.alert_id = f.alert_id)"""
ROUTED = "CASE WHEN severity IN ('critical', 'emergency') THEN 'email,slack' ELSE 'slack' END"


@query("alert_suppress", sql_with("alerts", f"WITH {CHAIN} SELECT alert_id, rate_key, ts, sent FROM decided", recursive=True))
def alert_suppress(spark, d):
    return al.suppress(v.alerts(spark, d)).select("alert_id", "rate_key", "ts", "sent")


def landed(alerts, folder: str, steps: int = 3):
    """Land alerts below a folder in steps of time, up to five minutes late, and yield after each step."""
    late = F.pmod(F.xxhash64("alert_id"), F.lit(5 * al.MINUTE))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = alerts.agg(F.min(at), F.max(at + late)).first()
    step = ((high or 0) - (low or 0)) // steps + 1
    for i in range(steps):
        part = alerts.filter((at + late).between((low or 0) + i * step, (low or 0) + (i + 1) * step - 1))
        part.write.mode("append").parquet(folder)
        yield i


def streamed(spark, alerts, **limits):
    """The stream, stopped and started again after each landing: what is carried from one run to the next decides."""
    folder, out = scratch_path(spark, "alerts-in"), scratch_path(spark, "alerts-out")
    job = jobs.Suppression(f"{out}/data", f"{out}/state", **limits)
    for _ in landed(alerts, folder):
        job.start(jobs.parquet_chunks(spark, folder, alerts.schema, files_per_chunk=10_000)).awaitTermination()
    job.close(spark)
    return spark.read.parquet(f"{out}/data").drop("trigger")


@query("alert_stream", sql_with("alerts", f"WITH {CHAIN} SELECT alert_id, rate_key, ts, sent FROM decided", recursive=True))
def alert_stream(spark, d):
    return streamed(spark, v.alerts(spark, d))


@query("alert_routing", sql_with("alerts", f"SELECT alert_id, severity, {ROUTED} AS channels FROM alerts"))
def alert_routing(spark, d):
    return al.route(v.alerts(spark, d)).select("alert_id", "severity", F.array_join("channels", ",").alias("channels"))


# Amounts have four decimals; half a cent goes up.
@query(
    "alert_messages",
    sql_with(
        "daily",
        f"""WITH {qa.FULL_RECORDS} SELECT 'Anomaly Detected: ' || metric_name AS title, 'Anomaly detected in ' || metric_name || '.' || chr(10) || 'Entity: ' || entity_id || chr(10) || 'Actual Value: '
            || printf('%.2f', round(actual_value::DECIMAL(20, 4), 2)::DOUBLE) || chr(10) || 'Expected Value: ' || printf('%.2f', expected_value) || chr(10) || 'Deviation: ' || printf('%.1f', deviation_percentage) || '%' || chr(10)
            || 'Confidence: ' || printf('%.1f', confidence_score * 100) || '%' || chr(10) || chr(10) || 'Recommendation: ' || recommendation AS message, severity, timestamp AS ts,
            printf('%.2f', z_score) AS z_label, 'anomaly_' || metric_name || '_' || entity_id AS dedup_key FROM records""",
    ),
)
def alert_messages(spark, d):
    return al.anomaly_alerts(qa.records(spark, d)).withColumn("z_label", F.col("metadata")["Z-Score"]).drop("metadata")


@query(
    "alert_health",
    """SELECT 'Health Check: ' || event_type AS title, 'Component ''' || event_type || ''' is ' || status || '.' AS message, CASE WHEN status = 'healthy' THEN 'info' ELSE 'critical' END AS severity, ts, 'health_' || event_type AS dedup_key
       FROM (SELECT *, CASE WHEN value < 100 THEN 'healthy' WHEN value < 200 THEN 'degraded' ELSE 'down' END AS status FROM events)""",
)
def alert_health(spark, d):
    value = F.col("value")
    status = F.when(value < 100, "healthy").when(value < 200, "degraded").otherwise("down")
    return al.health_alerts(v.table(spark, d, "events").select(F.col("event_type").alias("component"), status.alias("status"), "ts"))


def _sent(spark, d):
    return al.route(al.suppress(v.alerts(spark, d)).filter("sent"))


@query("alert_history", sql_with("alerts", f"WITH {CHAIN} SELECT alert_id, title, severity, ts FROM decided WHERE sent AND severity = 'critical' ORDER BY ts DESC, alert_id DESC LIMIT 100", recursive=True))
def alert_history(spark, d):
    return al.alert_history(_sent(spark, d), severity="critical").select("alert_id", "title", "severity", "ts")


@query(
    "alert_stats",
    sql_with(
        "alerts",
        f"""WITH {CHAIN}, sent AS (SELECT *, {ROUTED} AS channels FROM decided WHERE sent)
        SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM sent UNION ALL SELECT 'severity', severity, count(*) FROM sent GROUP BY 2
        UNION ALL SELECT 'channel', c, count(*) FROM (SELECT unnest(string_split(channels, ',')) AS c FROM sent) GROUP BY 2
        UNION ALL SELECT 'last_alert', 'alert_id', arg_max(alert_id, ts) FROM sent""",
        recursive=True,
    ),
)
def alert_stats(spark, d):
    return al.alert_stats(_sent(spark, d))
