"""Registered queries: replay of every trace and every session."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.plans import replay

from .core import EV, register
from .projection import events


def _nodes(scope):
    # a span id occurs once in the projection, so its first and last row are the same
    return f"""nd AS (SELECT {scope} AS scope, span_id, parent_id, ts, coalesce(reasoning_step_index, 2147483647) AS step, event_outcome, event_action, component_type,
    tool_name, request_model, agent_name, latency_ms, message, reasoning_action, reasoning_decision_type, reasoning_rationale, feedback_score, feedback_sentiment FROM ev WHERE {scope} IS NOT NULL)"""


def _tree(scope):
    return f"""{EV.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_nodes(scope)},
lk AS (SELECT nd.*, p.span_id AS up FROM nd LEFT JOIN nd p ON p.scope = nd.scope AND p.span_id = nd.parent_id),
tr AS (SELECT scope, span_id, span_id AS root, 0 AS depth, span_id AS path FROM lk WHERE up IS NULL
  UNION ALL SELECT lk.scope, lk.span_id, tr.root, tr.depth + 1, tr.path || '/' || lk.span_id FROM lk JOIN tr ON tr.scope = lk.scope AND tr.span_id = lk.up)"""


def _replay(scope, name):
    @register(
        f"replay_{name}",
        f"{_tree(scope)} SELECT tr.scope, tr.span_id, root, CAST(depth AS INTEGER) AS depth, path, nd.event_outcome AS outcome FROM tr JOIN nd ON nd.scope = tr.scope AND nd.span_id = tr.span_id",
    )
    def plan(spark, sf):
        out = replay.replay(events(spark, sf), scope)
        path = F.array_join(F.transform("path", lambda p: p["span_id"]), "/")
        return out.select("scope", "span_id", "root", "depth", path.alias("path"), "outcome")

    register(
        f"replay_{name}_stats",
        f"{EV}, {_nodes(scope)} SELECT nd.scope, count(*) AS total_events, count(*) FILTER (p.span_id IS NULL) AS root_count FROM nd LEFT JOIN nd p ON p.scope = nd.scope AND p.span_id = nd.parent_id GROUP BY nd.scope",
    )(lambda spark, sf: replay.stats(events(spark, sf), scope).select("scope", F.col("total_events"), "root_count"))


_replay("trace_id", "tree")
_replay("conversation_id", "sessions")

TEXT = """concat_ws(chr(10),
 repeat('  ', depth) || concat_ws(' ', CASE event_outcome WHEN 'success' THEN '✓' WHEN 'failure' THEN '✗' ELSE '·' END, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ']',
   event_action, '(' || component_type || ')', 'tool=' || tool_name, 'model=' || request_model, 'agent=' || agent_name,
   CASE WHEN latency_ms <> 0 THEN CAST(CAST(round_even(latency_ms, 0) AS BIGINT) AS VARCHAR) || 'ms' END),
 CASE WHEN reasoning_action IS NOT NULL THEN repeat('  ', depth) || concat_ws(' ', '  💭', 'decided=' || reasoning_action, 'type=' || reasoning_decision_type) END,
 CASE WHEN reasoning_action IS NOT NULL AND reasoning_rationale IS NOT NULL THEN repeat('  ', depth) || '  📝 ' || reasoning_rationale END,
 CASE WHEN feedback_score IS NOT NULL THEN repeat('  ', depth) || concat_ws(' ', '  👤', 'score=' || CAST(feedback_score AS VARCHAR), 'sentiment=' || feedback_sentiment) END,
 repeat('  ', depth) || '  → ' || message)"""

register(
    "replay_text",
    f"{_tree('trace_id')} SELECT tr.scope, tr.span_id, {TEXT} AS text FROM tr JOIN nd ON nd.scope = tr.scope AND nd.span_id = tr.span_id",
)(lambda spark, sf: replay.lines(replay.replay(events(spark, sf))).select("scope", "span_id", "text"))


def _toured(scope, name):
    register(
        f"replay_{name}_tour",
        f"""{EV.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_nodes(scope)},
lk AS (SELECT nd.*, p.span_id AS up FROM nd LEFT JOIN nd p ON p.scope = nd.scope AND p.span_id = nd.parent_id),
tr AS (SELECT scope, span_id, span_id AS root, 0 AS depth, [(ts, step, span_id)] AS path FROM lk WHERE up IS NULL
  UNION ALL SELECT lk.scope, lk.span_id, tr.root, tr.depth + 1, list_append(tr.path, (ts, step, lk.span_id)) FROM lk JOIN tr ON tr.scope = lk.scope AND tr.span_id = lk.up),
an AS (SELECT scope, span_id AS top, span_id, up FROM lk UNION ALL SELECT an.scope, lk.span_id, an.span_id, lk.up FROM an JOIN lk ON lk.scope = an.scope AND lk.span_id = an.up),
sm AS (SELECT an.scope, top, count(*) AS events, count(*) FILTER (event_outcome = 'failure') AS failures, sum(CAST(latency_ms AS DECIMAL(30,6))) AS latency
  FROM an JOIN nd ON nd.scope = an.scope AND nd.span_id = an.span_id GROUP BY 1, 2)
SELECT tr.scope, tr.span_id, root, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY tr.scope ORDER BY path) - 1 AS pre,
  row_number() OVER (PARTITION BY tr.scope ORDER BY path) + events - 2 AS last, events, failures, CAST(latency AS DOUBLE) AS latency
FROM tr JOIN sm ON sm.scope = tr.scope AND sm.top = tr.span_id""",
    )(lambda spark, sf: replay.toured(events(spark, sf), scope).withColumn("latency", F.col("latency").cast("double")))


_toured("trace_id", "trace")
_toured("conversation_id", "session")
