"""Registered queries: normalisation, sources, filters and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import normalize_text
from spanloom.operators import filters, histogram, normalize
from spanloom.sources import events as store
from spanloom.sources import feedback, otlp

from .core import EV, register
from .projection import events, table

# Three shapes of message text: a JSON object, a nested one and plain text.
MESSAGE = """CASE event_id % 4
 WHEN 0 THEN props
 WHEN 1 THEN '{"event": {"action": "' || event_type || '"}, "gen_ai": {"tool": {"name": "tool_' || CAST(user_id % 12 AS VARCHAR(9)) || '"}, "agent_ext": {"latency_ms": ' || CAST(user_id AS VARCHAR(9)) || '}, "prompt": "secret"}, "error": {"type": "timeout"}}'
 WHEN 2 THEN '{"gen_ai.request.model": "m' || CAST(user_id % 3 AS VARCHAR(9)) || '", "service": {"name": "s' || CAST(user_id % 4 AS VARCHAR(9)) || '", "tier": "gold"}, "event": {"outcome": "failure"}}'
 ELSE 'plain ' || event_type END"""
LONG = "repeat(event_type || ' ', CAST(user_id % 300 AS INT))"


def _messages(spark, sf):
    text = MESSAGE.replace("VARCHAR(9)", "STRING")
    return table(spark, sf, "events").selectExpr(
        "event_id", "ts", f"{text} AS message", f"{LONG} AS reasoning_rationale", f"{LONG} AS reasoning_input_summary", f"{LONG} AS feedback_comment",
        "'trace-' || event_id AS trace_id",
    )


@register(
    "normalize_message",
    f"""WITH m AS (SELECT *, event_id % 4 AS s FROM events)
    SELECT 'trace-' || event_id AS trace_id, CASE s WHEN 1 THEN event_type END AS event_action, CASE s WHEN 1 THEN 'tool_' || (user_id % 12) END AS tool_name,
    CASE s WHEN 2 THEN 'm' || (user_id % 3) END AS request_model, CASE s WHEN 2 THEN 's' || (user_id % 4) END AS service_name,
    CASE s WHEN 1 THEN CAST(user_id AS DOUBLE) END AS latency_ms, CASE s WHEN 1 THEN user_id * 1000000 END AS event_duration,
    CASE s WHEN 1 THEN 'failure' WHEN 2 THEN 'failure' ELSE 'success' END AS event_outcome, 'event' AS event_kind, 'process' AS event_category,
    s = 1 AS message_rewritten FROM m""",
)
def normalize_message(spark, sf):
    raw = _messages(spark, sf)
    out = normalize.normalize(raw)
    rewritten = out["message"].startswith("{") & ~F.coalesce(out["message"].contains("secret"), F.lit(False)) & out["message"].contains("latency_ms")
    return out.select(
        "trace_id", "event_action", "tool_name", "request_model", "service_name", "latency_ms", "event_duration", "event_outcome",
        "event_kind", "event_category", rewritten.alias("message_rewritten"),
    )


@register(
    "unmapped_keys",
    """SELECT 'trace-' || event_id AS trace_id, CASE event_id % 4 WHEN 0 THEN 'k' ELSE 'service.tier' END AS key,
    CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') ELSE 'gold' END AS value FROM events WHERE event_id % 4 IN (0, 2)""",
)
def unmapped_keys(spark, sf):
    out = normalize.normalize(_messages(spark, sf))
    return out.select("trace_id", F.explode("unmapped"))


def _cut(limit):
    return f"CASE WHEN length(t) > {limit} THEN left(t, {limit}) || '... [truncated]' ELSE t END"


@register(
    "redact_truncate",
    f"""WITH m AS (SELECT event_id, {LONG} AS t FROM events) SELECT 'trace-' || event_id AS trace_id,
    {_cut(500)} AS reasoning_rationale, {_cut(300)} AS reasoning_input_summary, {_cut(1000)} AS feedback_comment, false AS leaked FROM m""",
)
def redact_truncate(spark, sf):
    out = normalize.normalize(_messages(spark, sf))
    leaked = F.coalesce(F.col("message").contains("secret"), F.lit(False))
    return out.select("trace_id", "reasoning_rationale", "reasoning_input_summary", "feedback_comment", leaked.alias("leaked"))


# ---------------------------------------------------------------- OTLP payloads built from the events table
LOG_PAYLOAD = """'{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-' || (user_id % 4) || '"}},{"key":"x","value":{"stringValue":"resource"}}]},
"scopeLogs":[{"scope":{"name":"shop","version":"1"},"logRecords":[{"timeUnixNano":"' || (1704067200000000000 + event_id * 1000001) || '","severityText":"' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'Info' END || '",
"traceId":"AB' || event_id || '","spanId":"CD' || event_id || '","body":{"stringValue":"' || event_type || '"},
"attributes":[{"key":"gen_ai.usage.input_tokens","value":{"intValue":"' || user_id || '"}},{"key":"gen_ai.agent_ext.cache_hit","value":{"boolValue":' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || '}},
{"key":"gen_ai.prompt","value":{"stringValue":"secret"}},{"key":"x","value":{"arrayValue":{"values":[{"intValue":"' || user_id || '"},{"stringValue":"a"}]}}}' || CASE WHEN event_id % 10 = 0 THEN ',
{"key":"four","value":' || repeat('{"arrayValue":{"values":[', 4) || '{"intValue":"' || user_id || '"}' || repeat(']}}', 4) || '},
{"key":"six","value":' || repeat('{"kvlistValue":{"values":[{"key":"k","value":', 3) || repeat('{"arrayValue":{"values":[', 3) || '{"stringValue":"é"},{"boolValue":true}' || repeat(']}}', 3) || repeat('}]}}', 3) || '}' ELSE '' END || ']}]}]}]}'"""
SPAN_PAYLOAD = """'{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-' || (user_id % 4) || '"}}]},
"scopeSpans":[{"scope":{"name":"shop"},"spans":[{"name":"' || event_type || '","kind":' || (1 + user_id % 5) || ',"traceId":"T' || event_id || '","spanId":"S' || event_id || '","parentSpanId":"P' || user_id || '",
"startTimeUnixNano":"' || (1704067200000000000 + event_id * 1000) || '","endTimeUnixNano":"' || (1704067200000000000 + event_id * 1000 + user_id * 500 - 5000) || '",
"status":{"code":"' || CASE event_type WHEN 'error' THEN 'STATUS_CODE_ERROR' WHEN 'view' THEN 'STATUS_CODE_UNSET' ELSE 'STATUS_CODE_OK' END || '"},
"attributes":[{"key":"gen_ai.tool.name","value":{"stringValue":"tool_' || (user_id % 12) || '"}}]}]}]}]}'"""


def _payloads(spark, sf, payload, schema, signal):
    text = payload.replace("\n", "")
    rows = table(spark, sf, "events").selectExpr(f"{text} AS body")
    return rows.select(F.from_json("body", schema).alias("p")).select(f"p.{signal}")


@register(
    "otlp_logs",
    """SELECT make_timestamp(CAST(floor((1704067200000000000 + event_id * 1000001) / 1000) AS BIGINT)) AS ts, 'svc-' || (user_id % 4) AS service_name, 'otlp.log' AS event_action,
    CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS log_level, CASE event_type WHEN 'error' THEN 17 ELSE 9 END AS severity_number,
    'ab' || event_id AS trace_id, 'cd' || event_id AS span_id, event_type AS message, user_id AS input_tokens, user_id % 2 = 0 AS cache_hit,
    '[' || user_id || ', "a"]' AS x, CASE WHEN event_id % 10 = 0 THEN '[[[[' || user_id || ']]]]' END AS four,
    CASE WHEN event_id % 10 = 0 THEN '{"k": {"k": {"k": [[["é", true]]]}}}' END AS six FROM events""".replace("floor((1704067200000000000 + event_id * 1000001) / 1000)", "(1704067200000000000 + event_id * 1000001) // 1000"),
)
def otlp_logs(spark, sf):
    out = otlp.log_events(_payloads(spark, sf, LOG_PAYLOAD, otlp.OTLP_LOGS, "resourceLogs"))
    return out.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "service_name", "event_action", "log_level", "severity_number", "trace_id", "span_id",
        "message", "input_tokens", "cache_hit", *[F.col("unmapped")[k].alias(k) for k in ("x", "four", "six")],
    )


@register(
    "otlp_traces",
    """SELECT 't' || event_id AS trace_id, 's' || event_id AS span_id, 'p' || user_id AS parent_id, event_type AS event_action, event_type AS span_name,
    ['internal','server','client','producer','consumer'][1 + user_id % 5] AS span_kind,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN NULL ELSE 'success' END AS event_outcome,
    CASE WHEN user_id * 500 - 5000 >= 0 THEN user_id * 500 - 5000 END AS event_duration, 'tool_' || (user_id % 12) AS tool_name FROM events""",
)
def otlp_traces(spark, sf):
    out = otlp.span_events(_payloads(spark, sf, SPAN_PAYLOAD, otlp.OTLP_TRACES, "resourceSpans"))
    return out.select("trace_id", "span_id", "parent_id", "event_action", "span_name", "span_kind", "event_outcome", "event_duration", "tool_name")


FEEDBACK = """SELECT CAST(user_id % 5 - 2 AS VARCHAR(9)) AS score, CASE WHEN user_id % 7 = 0 THEN 'mixed' END AS sentiment, event_type AS comment,
 CASE WHEN event_id % 2 = 0 THEN 'trace-' || CAST(CAST(floor(event_id / 8) AS BIGINT) AS VARCHAR(20)) END AS trace_id, 'sess-' || user_id AS session_id,
 CAST(user_id AS VARCHAR(9)) AS user_id, CAST(NULL AS VARCHAR(9)) AS service_name FROM {events}"""


def _feedback(spark, sf):
    text = FEEDBACK.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")
    return feedback.feedback_events(spark.sql(text, events=table(spark, sf, "events")))


SENTIMENT = "coalesce(sentiment, CASE WHEN CAST(score AS DOUBLE) > 0 THEN 'positive' WHEN CAST(score AS DOUBLE) < 0 THEN 'negative' ELSE 'neutral' END)"
FB = f"f AS ({FEEDBACK.replace('{events}', 'events')})"

register(
    "feedback_rows",
    f"""WITH {FB} SELECT CAST(score AS DOUBLE) AS feedback_score, {SENTIMENT} AS feedback_sentiment, comment AS message, trace_id, session_id AS conversation_id,
    user_id AS feedback_user_id, 'user-feedback' AS service_name, 'feedback' AS event_dataset FROM f""",
)(
    lambda spark, sf: _feedback(spark, sf).select(
        "feedback_score", "feedback_sentiment", "message", "trace_id", "conversation_id", "feedback_user_id", "service_name", "event_dataset"
    )
)

register(
    "feedback_join",
    f"""{EV}, {FB}, s AS (SELECT coalesce('trace:' || trace_id, 'session:' || session_id) AS about, count(*) AS scores, CAST(sum(CAST(score AS DECIMAL(20,6))) AS DOUBLE) AS score_sum FROM f GROUP BY 1),
    n AS (SELECT about, count(*) AS events FROM (SELECT 'trace:' || trace_id AS about FROM ev UNION ALL SELECT 'session:' || conversation_id FROM ev) GROUP BY 1)
    SELECT s.about, scores, score_sum, coalesce(events, 0) AS events FROM s LEFT JOIN n ON s.about = n.about""",
)(lambda spark, sf: feedback.feedback_on(events(spark, sf), _feedback(spark, sf)))

# ---------------------------------------------------------------- filters, metrics, text
register("severity_filter", f"{EV} SELECT event_id, severity_number FROM ev WHERE severity_number >= 13")(
    lambda spark, sf: filters.min_severity(events(spark, sf), "warn").select("event_id", "severity_number")
)

register(
    "trace_sample",
    f"{EV} SELECT event_id, trace_id FROM ev WHERE CAST(('0x' || substr(md5(trace_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.25",
)(lambda spark, sf: filters.sample_traces(events(spark, sf), 0.25).select("event_id", "trace_id"))

EDGES = ", ".join(f"count(*) FILTER (event_duration <= {e * 1_000_000}) AS le_{e}" for e in histogram.DURATION_EDGES_MS)
METRICS = f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, service_name, tool_name, request_model, event_outcome, count(*) AS calls, count(event_duration) AS duration_count,
 CAST(coalesce(sum(event_duration),0) AS BIGINT) AS duration_sum, CAST(coalesce(sum(retry_count),0) AS BIGINT) AS retries,
 CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS tokens_out, {EDGES} FROM ev GROUP BY 1,2,3,4,5"""

register("span_metrics", f"{EV} {METRICS}")(lambda spark, sf: histogram.span_metrics(events(spark, sf), "1 hour"))

ADDITIVE = ["calls", "duration_count", "duration_sum", "retries", "tokens_in", "tokens_out", *[f"le_{e}" for e in histogram.DURATION_EDGES_MS]]
register(
    "metrics_roll_up",
    f"{EV}, m AS ({METRICS}) SELECT service_name, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ADDITIVE) + " FROM m GROUP BY 1",
)(lambda spark, sf: histogram.roll_up(histogram.span_metrics(events(spark, sf), "1 hour"), ["service_name"]))

register(
    "text_normalize",
    r"""SELECT doc_id, md5(array_to_string([y for y in [trim(regexp_replace(x, '\s+', ' ', 'g'))
    for x in string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))] if y <> ''], chr(10))) AS digest FROM documents""",
)(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("digest")))

register(
    "audit_rows",
    """SELECT event_type AS tool_name, CASE WHEN user_id % 3 = 0 THEN 'healthy' ELSE 'broken' END AS audit_verdict,
    CASE WHEN user_id % 3 = 0 THEN 'success' ELSE 'failure' END AS event_outcome, 'internal.skill_audit' AS event_dataset, count(*) AS n FROM events GROUP BY 1, 2, 3""",
)(
    lambda spark, sf: store.audit_events(
        table(spark, sf, "events").selectExpr("event_type AS tool", "CASE WHEN user_id % 3 = 0 THEN 'healthy' ELSE 'broken' END AS verdict", "value AS duration_ms")
    )
    .groupBy("tool_name", "audit_verdict", "event_outcome", "event_dataset")
    .agg(F.count(F.lit(1)).alias("n"))
)
