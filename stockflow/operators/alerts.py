"""Alerts: suppression (deduplication, cooldown, hourly cap), routing, messages, history.

Whether an alert goes out depends on which earlier ones did, so each key's alerts form a recurrence.
After a quiet gap the state is empty again, which cuts a key into independent sessions; sessions
are processed in parallel by the same reducer the stream uses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.scalars import alert_channels
from stockflow.operators.ordered import HOT_ROWS, forward_fill, largest_group, over_entities

DEDUP_MINUTES = 60
COOLDOWN_MINUTES = 15
MAX_PER_HOUR = 20
CHANNELS = ["email", "slack"]
MINUTE = 60_000_000  # microseconds
HOUR = 60 * MINUTE


def reduce_alerts(sent: list[int], times, dedup, delivered, cooldown: int, cap: int) -> tuple[np.ndarray, list[int]]:
    """Decisions for one key's alerts in time order, and the send times later ones still depend on (all in microseconds).

    From each send the search jumps to the next moment at which another may follow, so the cost follows the sends.
    """
    times = np.asarray(times, np.int64)
    able, held = np.asarray(delivered).astype(bool), np.asarray(dedup).astype(bool)
    plain, keyed = np.flatnonzero(able & ~held), np.flatnonzero(able & held)
    decisions, start = np.zeros(len(times), bool), 0

    def following(places: np.ndarray, at: int) -> int:
        i = np.searchsorted(places, at)
        return int(places[i]) if i < len(places) else len(times)

    while cap > 0:
        after = start
        if sent:
            earliest = max(sent[-1] + cooldown, sent[-cap] + HOUR if len(sent) >= cap else sent[-1])
            start = max(start, int(np.searchsorted(times, earliest)))
            after = max(start, int(np.searchsorted(times, sent[-1] + DEDUP_MINUTES * MINUTE)))
        chosen = min(following(plain, start), following(keyed, after))
        if chosen >= len(times):
            break
        decisions[chosen], start = True, chosen + 1
        now = int(times[chosen])
        sent = [t for t in sent if now - t < HOUR] + [now]
    return decisions, sent


def with_rate_key(alerts: DataFrame) -> DataFrame:
    """Add ``rate_key``: the deduplication key, or title and severity when there is none."""
    key = F.coalesce(F.nullif(F.col("dedup_key"), F.lit("")), F.concat_ws("_", "title", "severity"))
    return alerts.withColumn("rate_key", key)


def _sessions(rows: DataFrame, gap: int, hot_rows: int | None) -> DataFrame:
    """Add ``_session``: start time of the run of alerts without a quiet gap."""
    order = ["_t", "alert_id"]
    lagged = over_entities(rows, ["rate_key"], order, lambda w: {"_prev": F.lag("_t").over(w)}, lookback=1, hot_rows=hot_rows)
    starts = lagged.withColumn("_session", F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= gap), F.col("_t")))
    return forward_fill(starts, ["_session"], ["rate_key"], order, hot_rows).drop("_prev")


def suppress(
    alerts: DataFrame, cooldown_minutes: float = COOLDOWN_MINUTES, max_per_hour: int = MAX_PER_HOUR, hot_rows: int = HOT_ROWS, carried: DataFrame | None = None
) -> DataFrame:
    """Add ``rate_key`` and ``sent`` to alerts (alert_id, title, severity, ts, dedup_key, optional delivered).

    Alerts of one moment are decided in the order of their ids, NULL first.  Sessions are hashed to partitions, sorted, and
    reduced as the rows stream by: a long session takes time but holds only its recent sends.  ``carried`` (rate_key, t in
    microseconds) are earlier sends, all before the first of ``alerts``.
    """
    cooldown = int(cooldown_minutes * MINUTE)
    keyed = with_rate_key(alerts)
    delivered = F.coalesce("delivered", F.lit(False)) if "delivered" in alerts.columns else F.lit(True)
    rows = keyed.select(
        F.struct(*alerts.columns).alias("alert"), "alert_id", "rate_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"),
        F.nullif(F.col("dedup_key"), F.lit("")).isNotNull().alias("_dedup"), delivered.alias("_delivered"), F.lit(False).alias("_carried"),
    )
    if carried is not None:
        none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("alert", "alert_id")}
        before = carried.select(*none.values(), "rate_key", F.col("t").alias("_t"), *[F.lit(x).alias(c) for c, x in (("_dedup", False), ("_delivered", True), ("_carried", True))])
        rows = rows.unionByName(before)
    largest = largest_group(rows, ["rate_key"])
    sessions = _sessions(rows, max(cooldown, HOUR), None if largest <= hot_rows else hot_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sent = None, []
        for batch in batches:
            keys, session = batch["rate_key"].to_pylist(), batch["_session"].to_numpy()
            times, dedup, able, old = (batch[c].to_numpy(zero_copy_only=False) for c in ("_t", "_dedup", "_delivered", "_carried"))
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or session[i] != session[i - 1]] + [len(keys)]
            decisions, start = [], 0
            for end in ends if keys else []:
                if (keys[start], session[start]) != current:
                    current, sent = (keys[start], session[start]), []
                told = int(np.count_nonzero(old[start:end]))  # earlier sends come first in their session
                sent = [*sent, *times[start : start + told].tolist()]
                decisions.append(np.zeros(told, bool))
                start += told
                made, sent = reduce_alerts(sent, times[start:end], dedup[start:end], able[start:end], cooldown, max_per_hour)
                decisions.append(made)
                start = end
            flags = np.concatenate(decisions) if decisions else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch["alert"], batch["rate_key"], pa.array(flags)], ["alert", "rate_key", "sent"])

    dealt = sessions.repartition("rate_key", "_session").sortWithinPartitions("rate_key", "_session", "_t", "alert_id")
    schema = T.StructType([T.StructField("alert", rows.schema["alert"].dataType), rows.schema["rate_key"], T.StructField("sent", T.BooleanType())])
    return dealt.drop("alert_id").mapInArrow(run, schema).filter("alert IS NOT NULL").select("alert.*", "rate_key", "sent")


# ---------------------------------------------------------------- routing and messages


def route(alerts: DataFrame, explicit: str | None = None, known: Sequence[str] = CHANNELS) -> DataFrame:
    """Add ``channels`` by severity; a non-null ``explicit`` list overrides, unknown channels are dropped."""
    default = alert_channels(F.col("severity"))
    asked = default if explicit is None else F.coalesce(F.col(explicit), default)
    return alerts.withColumn("channels", F.array_intersect(asked, F.array(*[F.lit(c) for c in known])))


# The wording of alerts that their readers expect.
MESSAGE = "Anomaly detected in %s.\nEntity: %s\nActual Value: %.2f\nExpected Value: %.2f\nDeviation: %.1f%%\nConfidence: %.1f%%\n\nRecommendation: %s"


def _percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value)


def anomaly_alerts(records: DataFrame) -> DataFrame:
    """Title, text, metadata and deduplication key for each anomaly record."""
    metric, entity = F.col("metric_name"), F.col("entity_id")
    text = F.format_string(
        MESSAGE,
        metric,
        entity,
        F.col("actual_value"),
        F.col("expected_value"),
        F.col("deviation_percentage"),
        F.col("confidence_score") * 100,
        F.coalesce("recommendation", F.lit("Investigate the anomaly.")),
    )
    details = F.create_map(
        F.lit("Metric"), metric, F.lit("Entity"), entity, F.lit("Deviation %"), _percent(F.col("deviation_percentage")),
        F.lit("Z-Score"), F.format_string("%.2f", F.col("z_score")), F.lit("Algorithm"), F.col("algorithm_used"),
    )
    return records.select(
        F.concat(F.lit("Anomaly Detected: "), metric).alias("title"),
        text.alias("message"),
        "severity",
        F.col("timestamp").alias("ts"),
        details.alias("metadata"),
        F.concat(F.lit("anomaly_"), metric, F.lit("_"), entity).alias("dedup_key"),
    )


def health_alerts(status: DataFrame) -> DataFrame:
    """One alert per (component, status, ts): critical unless healthy."""
    component = F.col("component")
    return status.select(
        F.concat(F.lit("Health Check: "), component).alias("title"),
        F.concat(F.lit("Component '"), component, F.lit("' is "), F.col("status"), F.lit(".")).alias("message"),
        F.when(F.col("status") == "healthy", "info").otherwise("critical").alias("severity"),
        "ts",
        F.concat(F.lit("health_"), component).alias("dedup_key"),
    )


# ---------------------------------------------------------------- history


def alert_history(sent: DataFrame, limit: int = 100, severity: str | None = None) -> DataFrame:
    """The newest ``limit`` sent alerts, optionally of one severity, newest first."""
    rows = sent if severity is None else sent.filter(F.col("severity") == severity)
    return rows.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(limit)


def alert_stats(sent: DataFrame) -> DataFrame:
    """(dimension, value, n): total, per severity, per channel, and the newest alert's id."""
    total = sent.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("dimension"), F.lit("all").alias("value"), "n")
    by_severity = sent.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(F.lit("severity").alias("dimension"), F.col("severity").alias("value"), "n")
    by_channel = sent.select(F.explode("channels").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("channel").alias("dimension"), "value", "n"
    )
    newest = sent.agg(F.max_by("alert_id", F.struct("ts", "alert_id")).cast("bigint").alias("n")).select(
        F.lit("last_alert").alias("dimension"), F.lit("alert_id").alias("value"), "n"
    )
    return total.unionByName(by_severity).unionByName(by_channel).unionByName(newest)
