"""Dashboard aggregates. A panel is a name, a shape and its column; drawing is left to the reader."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_if, failed, fixed, keep_external, mean, money, total
from ..functions.timeframe import at_least
from ..operators.facets import terms
from ..operators.filters import has_failure, in_session, in_trace
from ..operators.histogram import date_histogram, percentile_histogram
from ..operators.quantiles import merge_groups, quantiles

STREAM_COLUMNS = (
    "ts", "conversation_id", "agent_id", "turn_id", "component_type", "event_action", "service_name",
    "tool_name", "request_model", "operation_name", "latency_ms", "event_outcome", "error_type",
)
TRACE_COLUMNS = (
    "ts", "event_action", "event_outcome", "tool_name", "request_model", "component_type", "latency_ms",
    "turn_id", "span_id", "parent_agent_id", "reasoning_action", "reasoning_decision_type",
    "reasoning_rationale",
)

# name -> (column, failures only)
TERM_PANELS = {
    "top_sessions": ("conversation_id", False),
    "failed_sessions": ("conversation_id", True),
    "top_tools": ("tool_name", False),
    "events_by_component": ("component_type", False),
    "failures_by_component": ("component_type", True),
    "guardrail_actions": ("guardrail_action", False),
    "guardrail_categories": ("guardrail_category", False),
    "evaluation_outcomes": ("evaluation_outcome", False),
    "evaluation_dimensions": ("evaluation_dimension", False),
    "reasoning_actions": ("reasoning_action", False),
    "decision_types": ("reasoning_decision_type", False),
    "feedback_sentiment": ("feedback_sentiment", False),
}
SEARCHES = {
    "event_stream": (None, STREAM_COLUMNS),
    "failures_stream": (has_failure, STREAM_COLUMNS),
    "session_drilldown": (in_session, STREAM_COLUMNS),
    "trace_timeline": (in_trace, TRACE_COLUMNS),
}


def window(events: DataFrame, time_range: str = "now-24h", as_of=None) -> DataFrame:
    return events.where(at_least(events, time_range, as_of))


def event_rate(rows: DataFrame, interval: str, size: int | None = None) -> DataFrame:
    """Events per time bucket and outcome; all outcomes, or the ``size`` most frequent by the same counts."""
    counts = date_histogram(rows.where(F.col("event_outcome").isNotNull()), interval, ["event_outcome"], count=F.count(F.lit(1)))
    counts = counts.select("bucket", "event_outcome", "count")
    if size is None:
        return counts
    outcomes = counts.groupBy("event_outcome").agg(F.sum("count").alias("n")).orderBy(F.col("n").desc(), "event_outcome").limit(size)
    return counts.join(outcomes.select("event_outcome"), "event_outcome", "left_semi")


def latency(rows: DataFrame, interval: str, approx: bool = False) -> DataFrame:
    p = percentile_histogram(rows, interval, "event_duration", {"p50": 0.5, "p95": 0.95}, approx=approx)
    return p.select("bucket", F.col("p50").alias("p50_duration"), F.col("p95").alias("p95_duration"))


def token_usage(rows: DataFrame, interval: str) -> DataFrame:
    return date_histogram(rows, interval, input_tokens=total("input_tokens"), output_tokens=total("output_tokens"))


def cost_over_time(rows: DataFrame, interval: str) -> DataFrame:
    return date_histogram(rows, interval, cost=total(money("cost")).cast("double"))


def feedback_over_time(rows: DataFrame, interval: str) -> DataFrame:
    return date_histogram(rows, interval, avg_score=mean("feedback_score"))


def term_panel(rows: DataFrame, name: str, size: int = 10) -> DataFrame:
    column, only_failures = TERM_PANELS[name]
    return terms(rows.where(failed()) if only_failures else rows, column, size)


def cost_by_model(rows: DataFrame, size: int = 10) -> DataFrame:
    """Cost-bearing rows per model, with their summed cost beside the count."""
    return terms(rows.where(F.col("cost").isNotNull()), "request_model", size, cost=F.sum(money("cost")).cast("double"))


def search(rows: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """A saved row listing, newest first."""
    predicate, columns = SEARCHES[name]
    rows = rows if predicate is None else rows.where(predicate())
    ordered = rows.orderBy(F.col("ts").desc(), F.col("span_id").asc_nulls_last())
    return (ordered if size is None else ordered.limit(size)).select(*columns)


def load_specs(source: str | Iterable[Mapping] | Mapping) -> list[dict]:
    """Panel specs from a JSON text, a list, or ``{"panels": [...]}``."""
    if isinstance(source, str):
        source = json.loads(source)
    if isinstance(source, Mapping):
        source = source.get("panels", [])
    return [dict(spec) for spec in source if isinstance(spec, Mapping)]


def custom(rows: DataFrame, spec: Mapping, interval: str = "1 hour") -> DataFrame | None:
    """A user panel: ``terms``, ``sum`` over time or ``percentile``; other kinds give None."""
    kind = spec.get("aggregation", "terms")
    field = spec.get("field", "tool_name")
    if kind == "terms":
        return terms(rows, field, int(spec.get("size", 10)))
    if kind == "sum":
        return date_histogram(rows, spec.get("interval", interval), sum=total(F.col(field)))
    if kind == "percentile":
        return quantiles(rows, [], field, {"percentile": float(spec.get("percentile", 95)) / 100.0})
    return None


def dashboard(events: DataFrame, interval: str = "1 hour", time_range: str = "now-24h", as_of=None, extensions=()) -> dict:
    """All panels by name, each an unevaluated plan over the same window."""
    rows = window(events, time_range, as_of)
    out = {
        "event_rate": event_rate(rows, interval),
        "latency": latency(rows, interval),
        "token_usage": token_usage(rows, interval),
        "cost_by_model": cost_by_model(rows),
        "cost_over_time": cost_over_time(rows, interval),
        "feedback_over_time": feedback_over_time(rows, interval),
    }
    out.update({name: term_panel(rows, name) for name in TERM_PANELS})
    out.update({name: search(rows, name) for name in SEARCHES})
    for spec in load_specs(extensions):
        panel = custom(rows, spec, interval)
        if panel is not None:
            out[spec.get("id", "custom")] = panel
    return out
