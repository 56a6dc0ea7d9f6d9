"""Registered queries: templates, report, panels. Each entry pairs a plan with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.measures import fixed
from spanloom.plans import panels, queries, report

from .projection import AS_OF, RANGE, duckdb_projection, events

PLANS = {}
SQL = {}

EV = f"WITH ev AS ({duckdb_projection()})"
RECENT = "ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 31 DAY"
NOT_SANITY = "event_dataset IS DISTINCT FROM 'internal.sanity_check'"
NOT_INTERNAL = "NOT coalesce(starts_with(event_dataset, 'internal.'), false)"


def fx(expression: str, digits: int) -> str:
    """The same decimal rounding as the plans use, in SQL."""
    return f"CAST(round(CAST({expression} AS DECIMAL(30,{digits + 4})), {digits}) AS DOUBLE)"


def mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(20,6))) AS DOUBLE) / CAST(nullif(count({column}), 0) AS DOUBLE)"


def money(column: str = "cost") -> str:
    return f"sum(CAST({column} AS DECIMAL(20,9)))"


def register(name, sql=None):
    def keep(plan):
        PLANS[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return keep


TRACE = "ts, event_action, event_outcome, service_name, tool_name, request_model, latency_ms, turn_id, component_type, conversation_id, agent_id, span_id, input_tokens, output_tokens, error_type, message"
ERRORS = "ts, event_action, service_name, error_type, tool_name, request_model, latency_ms, conversation_id, agent_id, trace_id, component_type, message"
TIMELINE = "ts, event_action, event_outcome, tool_name, request_model, latency_ms, turn_id, component_type, semantic_kind, input_tokens, output_tokens, cost, span_id, error_type, message"


@register(
    "q_trace",
    f"""{EV}, r AS (SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS INTEGER) AS seq, {TRACE}
    FROM ev WHERE {NOT_SANITY}) SELECT * FROM r""",
)
def q_trace(spark, sf):
    return queries.traces(events(spark, sf))


@register(
    "q_timeline",
    f"""{EV}, i AS (SELECT agent_id AS run_id, * FROM ev UNION ALL SELECT trace_id AS run_id, * FROM ev),
    r AS (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, span_id) AS INTEGER) AS seq, {TIMELINE}
    FROM i WHERE {NOT_SANITY}) SELECT * FROM r""",
)
def q_timeline(spark, sf):
    return queries.timelines(events(spark, sf))


@register(
    "q_tools",
    f"""{EV} SELECT tool_name, count(*) AS calls, count(*) FILTER (event_outcome = 'failure') AS errors,
    {fx(mean('latency_ms'), 4)} AS avg_latency_ms, {fx('quantile_cont(latency_ms, 0.95)', 4)} AS p95_latency_ms
    FROM ev WHERE {RECENT} AND {NOT_SANITY} AND tool_name IS NOT NULL GROUP BY tool_name
    ORDER BY calls DESC, tool_name LIMIT 10""",
)
def q_tools(spark, sf):
    out = queries.tools(events(spark, sf), RANGE, 10, AS_OF)
    return out.select(
        "tool_name", "calls", "errors",
        fixed(F.col("avg_latency_ms"), 4).alias("avg_latency_ms"),
        fixed(F.col("p95_latency_ms"), 4).alias("p95_latency_ms"),
    )


@register(
    "q_errors",
    f"{EV} SELECT {ERRORS} FROM ev WHERE {RECENT} AND {NOT_SANITY} AND event_outcome = 'failure' ORDER BY ts DESC, span_id",
)
def q_errors(spark, sf):
    return queries.errors(events(spark, sf), RANGE, None, AS_OF)


@register(
    "q_sessions",
    f"""{EV} SELECT conversation_id, count(*) AS events, count(*) FILTER (event_outcome = 'failure') AS errors,
    count(DISTINCT tool_name) AS tools_used, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_tokens,
    {fx(f"coalesce({money()}, 0)", 8)} AS total_cost, min(ts) AS first_seen, max(ts) AS last_seen
    FROM ev WHERE {RECENT} AND {NOT_SANITY} GROUP BY conversation_id ORDER BY events DESC, conversation_id LIMIT 10""",
)
def q_sessions(spark, sf):
    return queries.sessions(events(spark, sf), RANGE, 10, AS_OF)


SCOPED = f"{EV}, s AS (SELECT * FROM ev WHERE {RECENT} AND {NOT_SANITY})"


@register(
    "report_scalars",
    f"""{SCOPED} SELECT count(*) AS documents,
    {fx("1.0 - count(*) FILTER (event_outcome = 'failure') / CAST(count(*) AS DOUBLE)", 4)} AS success_rate,
    {fx("count(*) FILTER (event_outcome = 'failure' AND tool_name IS NOT NULL) / CAST(count(tool_name) AS DOUBLE)", 4)} AS tool_error_rate,
    CAST(sum(retry_count) AS BIGINT) AS retry_total, CAST(sum(input_tokens) AS BIGINT) AS token_input_total,
    CAST(sum(output_tokens) AS BIGINT) AS token_output_total, CAST({money()} AS DOUBLE) AS cost_total,
    {fx('quantile_cont(event_duration, 0.5) / 1e6', 2)} AS p50_latency_ms,
    {fx('quantile_cont(event_duration, 0.95) / 1e6', 2)} AS p95_latency_ms FROM s""",
)
def report_scalars(spark, sf):
    return report.scalars(events(spark, sf), RANGE, AS_OF)


def _list(name, column, size, where="true"):
    return f"""SELECT '{name}' AS list, rank, key, count FROM (SELECT {column} AS key, count(*) AS count,
    CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) AS INTEGER) AS rank FROM s WHERE {column} IS NOT NULL AND {where} GROUP BY 1) WHERE rank <= {size}"""


FAIL = "event_outcome = 'failure'"


@register(
    "report_facets",
    SCOPED
    + " "
    + " UNION ALL ".join(
        [
            _list("top_sessions", "conversation_id", 5),
            _list("failed_sessions", "conversation_id", 5, FAIL),
            _list("top_components", "component_type", 8),
            _list("failed_components", "component_type", 8, FAIL),
            _list("top_tools", "tool_name", 5),
            _list("top_models", "request_model", 5),
            _list("mcp_methods", "tool_name", 5),
            _list("mcp_tools", "tool_name", 5, "component_type = 'mcp'"),
            _list("error_types", "error_type", 5),
        ]
    ),
)
def report_facets(spark, sf):
    return report.facets(events(spark, sf), RANGE, AS_OF)


@register(
    "report_slow_turns",
    f"""{SCOPED}, t AS (SELECT turn_id, count(*) AS doc_count, count(*) FILTER ({FAIL}) AS failure_count,
    {mean('latency_ms')} AS avg_latency FROM s GROUP BY turn_id),
    sess AS (SELECT turn_id, conversation_id, row_number() OVER (PARTITION BY turn_id ORDER BY count(*) DESC, conversation_id) AS r FROM s GROUP BY 1, 2),
    comp AS (SELECT turn_id, component_type, row_number() OVER (PARTITION BY turn_id ORDER BY count(*) DESC, component_type) AS r FROM s GROUP BY 1, 2)
    SELECT t.turn_id, t.doc_count, t.failure_count, {fx('t.avg_latency', 2)} AS avg_latency_ms, sess.conversation_id AS session_id, comp.component_type
    FROM t JOIN sess ON t.turn_id = sess.turn_id AND sess.r = 1 JOIN comp ON comp.turn_id = t.turn_id AND comp.r = 1
    ORDER BY t.avg_latency DESC, t.turn_id LIMIT 5""",
)
def report_slow_turns(spark, sf):
    return report.slow_turns(events(spark, sf), RANGE, AS_OF)


PANEL = f"{EV}, p AS (SELECT * FROM ev WHERE {RECENT})"
DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket"


def _panel(spark, sf):
    return panels.window(events(spark, sf), RANGE, AS_OF)


register(
    "panel_event_rate",
    f"{PANEL} SELECT {DAY}, event_outcome, count(*) AS count FROM p WHERE event_outcome IS NOT NULL GROUP BY 1, 2",
)(lambda spark, sf: panels.event_rate(_panel(spark, sf), "1 day"))


@register(
    "panel_latency",
    f"""{PANEL} SELECT {DAY}, {fx('quantile_cont(event_duration, 0.5) / 1e6', 4)} AS p50_ms,
    {fx('quantile_cont(event_duration, 0.95) / 1e6', 4)} AS p95_ms FROM p GROUP BY 1""",
)
def panel_latency(spark, sf):
    out = panels.latency(_panel(spark, sf), "1 day")
    return out.select(
        "bucket",
        fixed(F.col("p50_duration") / F.lit(1e6), 4).alias("p50_ms"),
        fixed(F.col("p95_duration") / F.lit(1e6), 4).alias("p95_ms"),
    )


register(
    "panel_token_usage",
    f"{PANEL} SELECT {DAY}, CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS output_tokens FROM p GROUP BY 1",
)(lambda spark, sf: panels.token_usage(_panel(spark, sf), "1 day"))

register(
    "panel_cost_over_time", f"{PANEL} SELECT {DAY}, CAST(coalesce({money()},0) AS DOUBLE) AS cost FROM p GROUP BY 1"
)(lambda spark, sf: panels.cost_over_time(_panel(spark, sf), "1 day"))


@register("panel_feedback_over_time", f"{PANEL} SELECT {DAY}, {fx(mean('feedback_score'), 4)} AS avg_score FROM p GROUP BY 1")
def panel_feedback(spark, sf):
    out = panels.feedback_over_time(_panel(spark, sf), "1 day")
    return out.select("bucket", fixed(F.col("avg_score"), 4).alias("avg_score"))


register(
    "panel_cost_by_model",
    f"""{PANEL} SELECT request_model, count(*) AS count, CAST({money()} AS DOUBLE) AS cost FROM p
    WHERE cost IS NOT NULL AND request_model IS NOT NULL GROUP BY 1 ORDER BY count DESC, request_model LIMIT 10""",
)(lambda spark, sf: panels.cost_by_model(_panel(spark, sf)))


def _term_panel(name, column, only_failures):
    where = f" AND {FAIL}" if only_failures else ""
    register(
        f"panel_{name}",
        f"{PANEL} SELECT {column}, count(*) AS count FROM p WHERE {column} IS NOT NULL{where} GROUP BY 1 ORDER BY count DESC, {column} LIMIT 10",
    )(lambda spark, sf: panels.term_panel(_panel(spark, sf), name))


for _name, (_column, _failures) in panels.TERM_PANELS.items():
    _term_panel(_name, _column, _failures)


def _search_panel(name, columns, where):
    register(f"panel_{name}", f"{PANEL} SELECT {', '.join(columns)} FROM p WHERE {where}")(
        lambda spark, sf: panels.search(_panel(spark, sf), name)
    )


_search_panel("event_stream", panels.STREAM_COLUMNS, "true")
_search_panel("failures_stream", panels.STREAM_COLUMNS, f"({FAIL} OR ingest_error IS NOT NULL)")
_search_panel("session_drilldown", panels.STREAM_COLUMNS, "(conversation_id IS NOT NULL OR turn_id IS NOT NULL OR agent_id IS NOT NULL)")
_search_panel("trace_timeline", panels.TRACE_COLUMNS, "trace_id IS NOT NULL")

register(
    "panel_ext_terms",
    f"{PANEL} SELECT error_type, count(*) AS count FROM p WHERE error_type IS NOT NULL GROUP BY 1 ORDER BY count DESC, error_type LIMIT 3",
)(lambda spark, sf: panels.custom(_panel(spark, sf), {"aggregation": "terms", "field": "error_type", "size": 3}))

register(
    "panel_ext_sum",
    f"{PANEL} SELECT {DAY}, CAST(coalesce(sum(retry_count),0) AS BIGINT) AS sum FROM p GROUP BY 1",
)(lambda spark, sf: panels.custom(_panel(spark, sf), {"aggregation": "sum", "field": "retry_count", "interval": "1 day"}))


@register("panel_ext_percentile", f"{PANEL} SELECT {fx('quantile_cont(event_duration, 0.9) / 1e6', 4)} AS p90_ms FROM p")
def panel_ext_percentile(spark, sf):
    out = panels.custom(_panel(spark, sf), {"aggregation": "percentile", "field": "event_duration", "percentile": 90})
    return out.select(fixed(F.col("percentile") / F.lit(1e6), 4).alias("p90_ms"))
