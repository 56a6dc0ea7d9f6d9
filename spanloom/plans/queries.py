"""Question templates: traces, tools, errors, sessions and run timelines.

Each has a form for one id and a form that answers for every id in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import average, count_if, exact, failed, fixed, keep_external, money, total
from ..functions.timeframe import at_least
from ..operators.facets import best, terms
from ..operators.ordering import numbered
from ..operators.quantiles import quantiles

TRACE_COLUMNS = (
    "ts", "event_action", "event_outcome", "service_name", "tool_name", "request_model", "latency_ms",
    "turn_id", "component_type", "conversation_id", "agent_id", "span_id", "input_tokens", "output_tokens",
    "error_type", "message",
)
ERROR_COLUMNS = (
    "ts", "event_action", "service_name", "error_type", "tool_name", "request_model", "latency_ms",
    "conversation_id", "agent_id", "trace_id", "component_type", "message",
)
TIMELINE_COLUMNS = (
    "ts", "event_action", "event_outcome", "tool_name", "request_model", "latency_ms", "turn_id",
    "component_type", "semantic_kind", "input_tokens", "output_tokens", "cost", "span_id", "error_type",
    "message",
)


def _recent(events: DataFrame, time_range: str, as_of) -> DataFrame:
    return keep_external(events, "sanity").where(at_least(events, time_range, as_of))


def _numbered(rows: DataFrame, group: str, size: int | None) -> DataFrame:
    """Rows with their place in their group; all of them unless a ``size`` is asked for."""
    placed = numbered(rows, [group], "ts", [F.col("span_id").asc_nulls_last()]).withColumn("seq", F.col("seq").cast("int"))
    return placed if size is None else placed.where(F.col("seq") <= size)


def _first(rows: DataFrame, size: int | None) -> DataFrame:
    return rows if size is None else rows.limit(size)


def trace(events: DataFrame, trace_id: str, size: int | None = None) -> DataFrame:
    """All events of one trace in time order."""
    rows = keep_external(events, "sanity").where(F.col("trace_id") == trace_id)
    return _first(rows.select(*TRACE_COLUMNS).orderBy("ts", F.col("span_id").asc_nulls_last()), size)


def traces(events: DataFrame, size: int | None = None) -> DataFrame:
    """The same for every trace, with the place of each event in its trace."""
    rows = keep_external(events, "sanity").where(F.col("trace_id").isNotNull())
    return _numbered(rows, "trace_id", size).select("trace_id", "seq", *TRACE_COLUMNS)


def tools(events: DataFrame, time_range: str = "now-24h", size: int | None = 10, as_of=None, approx: bool = False):
    """Calls, failures, mean and P95 latency per tool, most called first."""
    rows = _recent(events, time_range, as_of).where(F.col("tool_name").isNotNull())
    found = quantiles(
        rows,
        ["tool_name"],
        "latency_ms",
        {"p95_latency_ms": 0.95},
        approx,
        measures={
            "calls": F.count(F.lit(1)),
            "errors": count_if(failed()),
            "_sum": F.sum(exact("latency_ms")),
            "_timed": F.count("latency_ms"),
        },
    )
    named = found.select("tool_name", "calls", "errors", average("_sum", "_timed").alias("avg_latency_ms"), "p95_latency_ms")
    return best(named, "tool_name", "calls", size)


def errors(events: DataFrame, time_range: str = "now-24h", size: int | None = None, as_of=None) -> DataFrame:
    """Failures, newest first."""
    rows = _recent(events, time_range, as_of).where(failed())
    return _first(rows.orderBy(F.col("ts").desc(), F.col("span_id").asc_nulls_last()), size).select(*ERROR_COLUMNS)


def sessions(events: DataFrame, time_range: str = "now-24h", size: int | None = 10, as_of=None) -> DataFrame:
    """Activity per conversation; tokens are input tokens only."""
    return terms(
        _recent(events, time_range, as_of),
        "conversation_id",
        size,
        errors=count_if(failed()),
        tools_used=F.count_distinct("tool_name"),
        total_tokens=total("input_tokens"),
        total_cost=fixed(total(money("cost")), 8),
        first_seen=F.min("ts"),
        last_seen=F.max("ts"),
    ).withColumnRenamed("count", "events")


def timeline(events: DataFrame, run_id: str, size: int | None = None) -> DataFrame:
    """Events of one agent run, found by run id or by trace id, in time order."""
    rows = keep_external(events, "sanity").where((F.col("agent_id") == run_id) | (F.col("trace_id") == run_id))
    return _first(rows.select(*TIMELINE_COLUMNS).orderBy("ts", F.col("span_id").asc_nulls_last()), size)


def _run_ids() -> Column:
    return F.array_distinct(F.array_compact(F.array("agent_id", "trace_id")))


def timelines(events: DataFrame, size: int | None = None) -> DataFrame:
    """The same for every id an event can be found by."""
    rows = keep_external(events, "sanity").withColumn("run_id", F.explode(_run_ids()))
    return _numbered(rows, "run_id", size).select("run_id", "seq", *TIMELINE_COLUMNS)
