"""Driver tables as event rows: one SQL text that Spark and DuckDB both run.

Synthetic shaping only, so that every plan has something to read; no rows are
left out or added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
RANGE = "now-31d"
CURRENT = "now-2d"
BASELINE = "now-31d/now-2d"

PROJECTION = """
WITH b AS (SELECT event_id, ts, user_id, event_type, value, CAST({json} AS INT) AS k FROM {events}),
c AS (SELECT *, CASE WHEN event_type='click' THEN 'tool' WHEN event_type='view' THEN 'llm'
  WHEN event_type='purchase' THEN 'knowledge' WHEN event_type='signup' THEN 'guardrail'
  WHEN user_id % 3 = 0 THEN 'tool' WHEN user_id % 3 = 1 THEN 'llm' ELSE 'mcp' END AS component FROM b)
SELECT event_id, ts,
  'svc-' || CAST(user_id % 4 AS VARCHAR(20)) AS service_name,
  CASE WHEN k = 99 THEN 'internal.sanity_check' WHEN k = 98 THEN 'internal.alert_check' WHEN k % 10 = 7 THEN 'feedback' END AS event_dataset,
  event_type AS event_action,
  CASE WHEN event_type='error' THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE WHEN event_type='error' THEN CASE k % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'api_error' ELSE 'tool_error' END END AS error_type,
  CASE WHEN k = 13 THEN 'bad payload' END AS ingest_error,
  'trace-' || CAST(CAST(floor(event_id / 8) AS BIGINT) AS VARCHAR(20)) AS trace_id,
  'span-' || CAST(event_id AS VARCHAR(20)) AS span_id,
  CASE WHEN event_id % 8 > 0 THEN 'span-' || CAST(event_id - event_id % 8 + CAST(floor((event_id % 8 - 1) / 2) AS BIGINT) AS VARCHAR(20)) END AS parent_id,
  'sess-' || CAST(user_id AS VARCHAR(20)) AS conversation_id,
  'turn-' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(day(ts) AS VARCHAR(20)) AS turn_id,
  'run-' || CAST(user_id % 20 AS VARCHAR(20)) AS agent_id,
  'agent ' || CAST(user_id % 7 AS VARCHAR(20)) AS agent_name,
  component AS component_type,
  event_type || ' k=' || CAST(k AS VARCHAR(20)) AS message,
  CASE WHEN component IN ('tool','mcp') THEN 'tool_' || CAST(k % 12 AS VARCHAR(20)) END AS tool_name,
  CASE WHEN component <> 'guardrail' THEN CASE k % 6 WHEN 0 THEN 'gpt-4o-mini-2024-07-18' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'claude-3-5-sonnet-20241022'
     WHEN 3 THEN 'gemini-1.5-flash-002' WHEN 4 THEN 'GPT-4-turbo ' ELSE 'house-model-1' END END AS request_model,
  CASE WHEN component = 'llm' THEN 'chat' WHEN component IN ('tool','mcp') THEN 'execute_tool' ELSE 'retrieve' END AS operation_name,
  CASE WHEN k % 4 = 0 THEN 'retrieval' ELSE 'action' END AS semantic_kind,
  CASE WHEN component <> 'guardrail' THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens,
  CASE WHEN component <> 'guardrail' THEN CAST(k * 7 AS BIGINT) END AS output_tokens,
  CASE WHEN event_type='error' THEN k % 5 ELSE 0 END AS retry_count,
  value * 100 AS latency_ms,
  CAST(floor(value * 100) AS BIGINT) * 1000000 AS event_duration,
  CASE WHEN component <> 'guardrail' AND k % 3 = 0 THEN CAST(floor(value * 10) AS DOUBLE) / 1000000 END AS cost,
  CASE WHEN component = 'guardrail' THEN CASE k % 10 WHEN 0 THEN 'block' WHEN 1 THEN 'redact' ELSE 'pass' END END AS guardrail_action,
  CASE WHEN component = 'guardrail' THEN CASE k % 4 WHEN 0 THEN 'content_safety' WHEN 1 THEN 'prompt_injection' WHEN 2 THEN 'pii' ELSE 'custom' END END AS guardrail_category,
  CASE WHEN k % 9 = 4 THEN CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'degraded' END END AS evaluation_outcome,
  CASE WHEN k % 9 = 4 THEN CASE k % 4 WHEN 0 THEN 'quality' WHEN 1 THEN 'safety' WHEN 2 THEN 'latency' ELSE 'cost' END END AS evaluation_dimension,
  CASE WHEN component = 'llm' THEN CASE k % 5 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'delegate' WHEN 2 THEN 'respond' WHEN 3 THEN 'wait' ELSE 'escalate' END END AS reasoning_action,
  CASE WHEN component = 'llm' THEN CASE k % 3 WHEN 0 THEN 'routing' WHEN 1 THEN 'tool_selection' ELSE 'retry' END END AS reasoning_decision_type,
  CASE WHEN component = 'llm' THEN 'because ' || CAST(k AS VARCHAR(20)) END AS reasoning_rationale,
  CASE WHEN component = 'llm' THEN k % 4 END AS reasoning_step_index,
  CASE WHEN k % 10 = 7 THEN CAST(k % 3 - 1 AS DOUBLE) END AS feedback_score,
  CASE WHEN k % 10 = 7 THEN CASE k % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END END AS feedback_sentiment,
  CASE WHEN k % 5 = 0 THEN 'run-' || CAST((user_id + 1) % 20 AS VARCHAR(20)) END AS parent_agent_id,
  1 + k % 24 AS severity_number
FROM c
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shape(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Raw driver events (batch or stream) as event rows."""
    text = PROJECTION.replace("{json}", "get_json_object(props, '$.k')").replace("VARCHAR(20)", "STRING")
    return spark.sql(text, events=rows)


_SHAPED: dict = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unevaluated projection, analysed once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHAPED:
        _SHAPED[key] = shape(spark, table(spark, sf_dir, "events"))
    return _SHAPED[key]


def duckdb_projection() -> str:
    return PROJECTION.replace("{json}", "json_extract_string(props, '$.k')").replace("{events}", "events")
