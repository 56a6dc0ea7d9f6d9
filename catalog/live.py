"""Registered queries: sessions, joins of two streams, open windows, files batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.session import scratch_path
from spanloom.sources import events as store
from spanloom.streaming import ingest, joins, metrics, sessions, watch

from . import streams
from .core import EV, SQL, register
from .ingest import EDGES
from .projection import events, shape, table
from .streams import HOUR, _drain, _stream

# What the watermark knows: milliseconds, ten minutes behind the last row.
LATEST = "date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE"

# ---------------------------------------------------------------- sessions
GAP = "6 hours"
SESSIONS = f"""{EV}, s AS (SELECT *, CASE WHEN lag(ts) OVER o >= ts - INTERVAL {GAP} THEN 0 ELSE 1 END AS begins FROM ev
  WHERE conversation_id IS NOT NULL WINDOW o AS (PARTITION BY conversation_id ORDER BY ts)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY conversation_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s),
a AS (SELECT conversation_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS rows, count(*) FILTER (event_outcome = 'failure') AS failures,
  CAST(coalesce(sum(retry_count), 0) AS BIGINT) AS retries, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS tokens_out
  FROM g GROUP BY conversation_id, n)"""


def _ntz(rows, *columns):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@register("session_activity_stream", f"{SESSIONS} SELECT * FROM a WHERE session_end + INTERVAL {GAP} <= (SELECT {LATEST} FROM ev)")
def session_activity_stream(spark, sf):
    """Sessions as a stream writes them: those that the watermark has closed."""
    found = sessions.session_activity(_stream(spark, sf), GAP, "10 minutes")
    return _ntz(_drain(spark, found, "sessions"), "session_start", "session_end")


@register("session_activity", f"{SESSIONS} SELECT * FROM a")
def session_activity(spark, sf):
    return _ntz(sessions.session_activity(events(spark, sf), GAP), "session_start", "session_end")


@register(
    "session_shape",
    f"""{SESSIONS}, p AS (SELECT *, epoch_us(session_end) - epoch_us(session_start) AS us, epoch_us(session_start) - epoch_us(lag(session_end) OVER (PARTITION BY conversation_id ORDER BY session_start)) AS pause FROM a)
    SELECT conversation_id, count(*) AS sessions, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(us) AS BIGINT) AS active_us, max(us) AS longest_us, max(pause) AS longest_pause_us FROM p GROUP BY 1""",
)
def session_shape(spark, sf):
    return sessions.session_shape(sessions.session_activity(events(spark, sf), GAP))


# ---------------------------------------------------------------- two streams
# Roots of every fifth trace are lost, the others come twice; a root may be days away from its feedback.
FEEDBACK = "SELECT event_id AS feedback_id, ts, trace_id, feedback_score FROM {ev} WHERE event_dataset = 'feedback'"


@register(
    "feedback_stream",
    f"""{EV}, f AS ({FEEDBACK.replace('{ev}', 'ev')}), r AS (SELECT * FROM ev WHERE (event_id // 8) % 5 > 0 AND parent_id IS NULL),
    w AS (SELECT least((SELECT {LATEST} FROM ev WHERE event_dataset = 'feedback'), (SELECT {LATEST} FROM r)) AS at)
    SELECT f.feedback_id, f.ts, f.trace_id, f.feedback_score, r.ts AS root_ts, r.span_id AS root, r.event_action, r.event_outcome, r.event_duration
    FROM f LEFT JOIN r ON r.trace_id = f.trace_id AND r.ts >= f.ts - INTERVAL 12 MINUTE AND r.ts <= f.ts + INTERVAL 5 MINUTE, w
    WHERE r.span_id IS NOT NULL OR f.ts + INTERVAL 5 MINUTE < w.at""",
)
def feedback_stream(spark, sf):
    """Feedback beside the root of its trace; roots that never come, come twice, or lie out of range."""
    rows = _stream(spark, sf)
    feedback = spark.sql(FEEDBACK, ev=rows)
    roots = rows.where("(event_id div 8) % 5 > 0").select("ts", "trace_id", "span_id", "parent_id", "event_action", "event_outcome", "event_duration")
    joined = joins.feedback_with_traces(feedback.unionByName(feedback), roots.unionByName(roots), "12 minutes", "5 minutes", "10 minutes")
    return _ntz(_drain(spark, joined, "feedback-traces"), "ts", "root_ts")


# k decides what became of a canary: not sent, never landed, landed late, without its dataset, without its service.
SENT_AT = "SELECT 'c-' || event_id AS verify_id, ts, k % 11 <> 0 AS send_ok, CASE WHEN k % 22 = 0 THEN NULL ELSE 503 END AS status_code FROM {b}"
LANDED_AT = """SELECT 'c-' || event_id AS verify_id, ts + {late} AS ts, CASE WHEN k % 13 <> 0 THEN 'internal.pipeline_verify' END AS event_dataset,
 CASE WHEN k % 17 <> 0 THEN 'svc' END AS service_name FROM {b} WHERE k % 7 <> 0 AND k % 11 <> 0"""
BASE = "SELECT event_id, ts, CAST({json} AS INT) AS k FROM {events}"
_DUCK_BASE = BASE.replace("{json}", "json_extract_string(props, '$.k')").replace("{events}", "events")


@register(
    "canary_stream",
    f"""WITH b AS ({_DUCK_BASE}), s AS ({SENT_AT.replace('{b}', 'b')}), l AS ({LANDED_AT.replace('{b}', 'b').replace('{late}', 'to_minutes(k % 30)')}),
    w AS (SELECT least((SELECT {LATEST} FROM s), (SELECT {LATEST} FROM l)) AS at),
    j AS (SELECT s.*, l.verify_id IS NOT NULL AS landed, coalesce(event_dataset = 'internal.pipeline_verify', false) AS d, service_name IS NOT NULL AS n
      FROM s LEFT JOIN l ON s.verify_id = l.verify_id AND l.ts <= s.ts + INTERVAL 15 MINUTE)
    SELECT verify_id, CASE WHEN NOT send_ok THEN CASE WHEN status_code IS NULL THEN 'transport_unreachable' ELSE 'transport_rejected' END
     WHEN landed AND d AND n THEN 'ok' WHEN landed THEN 'contract_broken' ELSE 'sent_but_lost' END AS verdict,
     CASE WHEN send_ok AND landed THEN concat_ws(', ', CASE WHEN NOT d THEN 'event.dataset' END, CASE WHEN NOT n THEN 'service.name' END) END AS missing
    FROM j, w WHERE landed OR j.ts + INTERVAL 15 MINUTE < w.at""",
)
def canary_stream(spark, sf):
    """Canaries and landed rows as two streams; some rows late, lost or repeated."""
    raw = table(spark, sf, "events")
    rows = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    base = spark.sql(BASE.replace("{json}", "get_json_object(props, '$.k')"), events=rows)
    sent = spark.sql(SENT_AT, b=base)
    landed = spark.sql(LANDED_AT.replace("{late}", "make_dt_interval(0, 0, k % 30, 0)"), b=base)
    return _drain(spark, joins.canaries_landed(sent.unionByName(sent), landed.unionByName(landed), "15 minutes", "10 minutes"), "canaries")


# ---------------------------------------------------------------- open windows, several batches
@register(
    "span_metrics_live",
    f"""{EV} SELECT {HOUR}, service_name, event_outcome, count(*) AS calls, count(event_duration) AS duration_count,
    CAST(coalesce(sum(event_duration),0) AS BIGINT) AS duration_sum, CAST(coalesce(sum(retry_count),0) AS BIGINT) AS retries,
    CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS tokens_out, {EDGES} FROM ev GROUP BY 1, 2, 3""",
)
def span_metrics_live(spark, sf):
    """Every window with its last state, those at the end of the stream included."""
    out, dims = scratch_path(spark, "live"), ["service_name", "event_outcome"]
    metrics.keep_live(_stream(spark, sf), out, scratch_path(spark, "live-checkpoint"), "1 hour", dims, "10 minutes").awaitTermination()
    return _ntz(metrics.read_live(spark, out, dims), "bucket")


@register("ingest_batches", f"{EV} SELECT CAST(ts AS DATE) AS event_date, count(*) AS rows, count(DISTINCT span_id) AS spans FROM ev GROUP BY 1")
def ingest_batches(spark, sf):
    """A landing folder of several files, one file a batch, into the event table."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "table")
    raw = table(spark, sf, "events")
    raw.repartition(4, "event_id").write.parquet(landing)
    stream = shape(spark, spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(landing))
    rows = store.conform(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    ingest.start(rows, out, scratch_path(spark, "batches-checkpoint")).awaitTermination()
    return store.scan(spark, out).groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("span_id").alias("spans"))


# ---------------------------------------------------------------- alerts with the baseline in state
def _watched(spark, sf, slow=1, rows=False):
    facts, out = scratch_path(spark, "facts"), scratch_path(spark, "state-alerts")
    written = scratch_path(spark, "state-alert-rows") if rows else None
    stream = _stream(spark, sf).withColumn("event_duration", F.col("event_duration") * slow)
    watch.roll_up(stream, facts, scratch_path(spark, "facts-checkpoint"), streams.EVERY, ["service_name"], "10 minutes").awaitTermination()
    query = watch.watch(spark, facts, out, scratch_path(spark, "state-checkpoint"), streams.EVERY, streams.BASELINE, streams.RULES, rows_out=written)
    query.awaitTermination()
    return spark.read.parquet(written or out)


@register("alert_state_stream", SQL["alert_stream"])
def alert_state_stream(spark, sf):
    """The same alerts as alert_stream; no event is read twice."""
    return streams._values(_watched(spark, sf))


@register("alert_state_slow", f"SELECT * FROM ({SQL['alert_windows_slow']}) WHERE {streams.CLOSED_DAYS.replace('ev)', 'events)')}")
def alert_state_slow(spark, sf):
    """Latency alerts with exact baselines, durations of minutes."""
    return streams._values(_watched(spark, sf, 20)).where(F.col("alert_type") == "latency_degradation")


@register("alert_state_rows", SQL["alert_stream_rows"])
def alert_state_rows(spark, sf):
    return _watched(spark, sf, rows=True).select("scope", "event_action", "event_outcome", "alert_severity", "event_dataset")
