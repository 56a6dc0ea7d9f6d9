"""Registered queries: streaming twins and alerts per window."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import histogram
from spanloom.plans import alerts
from spanloom.session import scratch_path
from spanloom.sources.events import conform
from spanloom.streaming import ingest, metrics
from spanloom.streaming import alerts as stream_alerts

from .core import EV, FAIL, NOT_INTERNAL, fx, register
from .ingest import EDGES
from .projection import events, shape, table


def _stream(spark, sf):
    """The events file as a stream, projected like the batch rows."""
    raw = table(spark, sf, "events")
    return shape(spark, spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def _drain(spark, stream, label, partition_by=()):
    """Run a stream to its end and read what it wrote."""
    out = scratch_path(spark, label)
    ingest.start(stream, out, scratch_path(spark, f"{label}-checkpoint"), partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# A window is written when the watermark (latest time less the delay) has passed its end.
CLOSED = "bucket + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)"
HOUR = "CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket"


@register(
    "event_rate_stream",
    f"{EV} SELECT * FROM (SELECT {HOUR}, event_outcome, count(*) AS count FROM ev GROUP BY 1, 2) WHERE {CLOSED}",
)
def event_rate_stream(spark, sf):
    out = _drain(spark, metrics.stream_event_rate(_stream(spark, sf), "1 hour", "10 minutes"), "rate")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register(
    "span_metrics_stream",
    f"""{EV} SELECT * FROM (SELECT {HOUR}, service_name, event_outcome, count(*) AS calls, count(event_duration) AS duration_count,
    CAST(coalesce(sum(event_duration),0) AS BIGINT) AS duration_sum, CAST(coalesce(sum(retry_count),0) AS BIGINT) AS retries,
    CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS tokens_out, {EDGES} FROM ev GROUP BY 1, 2, 3) WHERE {CLOSED}""",
)
def span_metrics_stream(spark, sf):
    stream = metrics.stream_metrics(_stream(spark, sf), "1 hour", ["service_name", "event_outcome"], "10 minutes")
    return _drain(spark, stream, "metrics").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register(
    "ingest_stream",
    f"""{EV} SELECT CAST(ts AS DATE) AS event_date, event_outcome, count(*) AS rows, count(DISTINCT span_id) AS spans, CAST(sum(input_tokens) AS BIGINT) AS tokens
    FROM ev GROUP BY 1, 2""",
)
def ingest_stream(spark, sf):
    stream = conform(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    stored = _drain(spark, stream, "events", ["event_date"])
    return stored.groupBy("event_date", "event_outcome").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("span_id").alias("spans"), F.sum("input_tokens").alias("tokens")
    )


@register("dedup_stream", f"{EV} SELECT DISTINCT service_name, trace_id FROM ev")
def dedup_stream(spark, sf):
    rows = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(spark, ingest.drop_repeats(rows, ["service_name", "trace_id"], "10 minutes").select("service_name", "trace_id"), "dedup")


SPAN = "CASE WHEN event_id % 3 > 0 THEN trace_id END AS span_id"


@register("dedup_logs_stream", f"{EV} SELECT event_id, trace_id, {SPAN} FROM ev")
def dedup_logs_stream(spark, sf):
    """Every row delivered twice; spans have many logs, and some logs have no span."""
    rows = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).selectExpr("event_id", "ts", "trace_id", SPAN, "message")
    kept = ingest.drop_repeats(rows.unionByName(rows))
    return _drain(spark, kept.select("event_id", "trace_id", "span_id"), "dedup_logs")


# ---------------------------------------------------------------- alerts of every window
EVERY, BASELINE = "1 day", "7 days"
RULES = alerts.Rules(token_threshold_multiplier=0.2)
WINDOWS = f"""{EV}, x AS (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS w FROM ev WHERE {NOT_INTERNAL}),
sc AS (SELECT 'all' AS scope, * FROM x UNION ALL SELECT 'service_name=' || service_name, * FROM x),
m AS (SELECT scope, w, count(*) AS events, count(*) FILTER ({FAIL}) AS errors, CAST(sum(coalesce(input_tokens,0) + coalesce(output_tokens,0)) AS BIGINT) AS tokens,
  CAST(coalesce(sum(retry_count), 0) AS BIGINT) AS retries, quantile_cont(event_duration, 0.95) / 1e6 AS p95 FROM sc GROUP BY 1, 2),
bp AS (SELECT m.scope, m.w, quantile_cont(s.event_duration, 0.95) / 1e6 AS b_p95 FROM m JOIN sc s ON s.scope = m.scope AND s.w BETWEEN m.w - INTERVAL 7 DAY AND m.w - INTERVAL 1 DAY GROUP BY 1, 2),
b AS (SELECT *, sum(events) OVER f AS b_events, sum(errors) OVER f AS b_errors, coalesce(sum(tokens) OVER f, 0) AS b_tokens, coalesce(sum(retries) OVER f, 0) AS b_retries
  FROM m WINDOW f AS (PARTITION BY scope ORDER BY w RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
hs AS (SELECT scope, w, max(r) AS hot FROM (SELECT scope, w, conversation_id, coalesce(sum(retry_count), 0) AS r FROM sc WHERE conversation_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
fs AS (SELECT scope, w, max(n) AS hot FROM (SELECT scope, w, conversation_id, count(*) AS n FROM sc WHERE {FAIL} GROUP BY 1, 2, 3) GROUP BY 1, 2),
tu AS (SELECT scope, w, max(ms) AS ms FROM (SELECT scope, w, turn_id, {fx("CAST(sum(CAST(latency_ms AS DECIMAL(20,6))) AS DOUBLE) / count(latency_ms)", 2)} AS ms FROM sc GROUP BY 1, 2, 3) GROUP BY 1, 2),
a AS (SELECT b.scope || '@' || strftime(b.w, '%Y-%m-%d %H:%M:%S') AS scope, b.* EXCLUDE (scope), hs.hot AS hot_retries, coalesce(fs.hot, 0) AS hot_failures, tu.ms, bp.b_p95
  FROM b LEFT JOIN bp ON bp.scope = b.scope AND bp.w = b.w LEFT JOIN hs ON hs.scope = b.scope AND hs.w = b.w LEFT JOIN fs ON fs.scope = b.scope AND fs.w = b.w LEFT JOIN tu ON tu.scope = b.scope AND tu.w = b.w)"""
_E = fx("errors / CAST(greatest(events,1) AS DOUBLE)", 4)
_R = fx("tokens / CAST(greatest(b_tokens,1) AS DOUBLE)", 2)
FOUND = f"""SELECT scope, 'error_rate_spike' AS alert_type, CASE WHEN {_E} > 0.5 THEN 'critical' ELSE 'warning' END AS severity, {_E} AS value, CAST(NULL AS DOUBLE) AS baseline_p95_ms FROM a WHERE errors >= 10
UNION ALL SELECT scope, 'token_consumption_anomaly', CASE WHEN {_R} >= 5 THEN 'critical' ELSE 'warning' END, {_R}, NULL FROM a WHERE b_tokens > 0 AND tokens > b_tokens * CAST(0.2 AS DOUBLE)
UNION ALL SELECT scope, 'latency_degradation', CASE WHEN p95 >= 10000 THEN 'critical' ELSE 'warning' END, {fx('p95', 1)}, {fx('coalesce(b_p95, 0)', 1)} FROM a WHERE p95 >= 5000
UNION ALL SELECT scope, 'session_failure_hotspot', CASE WHEN hot_failures / CAST(errors AS DOUBLE) >= 0.6 THEN 'critical' ELSE 'warning' END, {fx('hot_failures / CAST(errors AS DOUBLE)', 4)}, NULL FROM a WHERE errors > 0 AND hot_failures >= 5 AND hot_failures / CAST(errors AS DOUBLE) >= 0.35
UNION ALL SELECT scope, 'retry_storm', CASE WHEN hot_retries >= 10 THEN 'critical' ELSE 'warning' END, CAST(retries AS DOUBLE), NULL FROM a WHERE NOT (hot_retries < 5 AND retries < 10)
UNION ALL SELECT scope, 'long_turn_hotspot', CASE WHEN ms >= 7500 THEN 'critical' ELSE 'warning' END, ms, NULL FROM a WHERE ms >= 3000"""


def _values(found):
    value = F.coalesce("error_rate", "ratio", "p95_ms", "concentration", F.col("total_retries").cast("double"), "turn_latency_ms")
    return found.select("scope", "alert_type", "severity", value.alias("value"), "baseline_p95_ms")


@register("alert_windows", f"{WINDOWS} {FOUND}")
def alert_windows(spark, sf):
    return _values(alerts.analyze(alerts.per_window(events(spark, sf), EVERY, BASELINE, RULES, ["service_name"])))


@register("alert_windows_slow", f"{WINDOWS.replace('SELECT *, CAST(date_trunc', 'SELECT * REPLACE (event_duration * 20 AS event_duration), CAST(date_trunc', 1)} SELECT * FROM ({FOUND}) WHERE alert_type = 'latency_degradation'")
def alert_windows_slow(spark, sf):
    """The same with durations of minutes."""
    slow = events(spark, sf).withColumn("event_duration", F.col("event_duration") * 20)
    only = ["latency_degradation"]
    return _values(alerts.analyze(alerts.per_window(slow, EVERY, BASELINE, RULES, ["service_name"], only), only=only))


LAST = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)"


@register(
    "alert_stream",
    f"{WINDOWS} SELECT f.* FROM ({FOUND}) f WHERE CAST(split_part(f.scope, '@', 2) AS TIMESTAMP) + INTERVAL 1 DAY <= {LAST}",
)
def alert_stream(spark, sf):
    out = scratch_path(spark, "alerts")
    query = stream_alerts.watch(
        spark, _stream(spark, sf), lambda: events(spark, sf), out, scratch_path(spark, "alerts-checkpoint"), EVERY, BASELINE, RULES, ["service_name"], "10 minutes"
    )
    query.awaitTermination()
    return _values(spark.read.parquet(out))


CLOSED_DAYS = f"CAST(split_part(scope, '@', 2) AS TIMESTAMP) + INTERVAL 1 DAY <= {LAST}"


@register(
    "alert_stream_rows",
    f"""{WINDOWS}, f AS (SELECT scope, alert_type, severity FROM ({FOUND}))
    SELECT scope, alert_type AS event_action, 'failure' AS event_outcome, severity AS alert_severity, 'internal.alert_check' AS event_dataset FROM f WHERE {CLOSED_DAYS}
    UNION ALL SELECT scope, 'alert_check_ok', 'success', NULL, 'internal.alert_check' FROM a WHERE scope NOT IN (SELECT scope FROM f) AND {CLOSED_DAYS}""",
)
def alert_stream_rows(spark, sf):
    """What the watch appends to the event table: a row per alert, and one per quiet window."""
    rows = scratch_path(spark, "alert-rows")
    query = stream_alerts.watch(
        spark, _stream(spark, sf), lambda: events(spark, sf), scratch_path(spark, "alerts"), scratch_path(spark, "alerts-checkpoint"),
        EVERY, BASELINE, RULES, ["service_name"], "10 minutes", rows_out=rows,
    )
    query.awaitTermination()
    return spark.read.parquet(rows).select("scope", "event_action", "event_outcome", "alert_severity", "event_dataset")
