"""Metrics report: scalars from one aggregation, every top list from one facet pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import average, count_if, exact, failed, fixed, keep_external, money, rate, total
from ..functions.timeframe import at_least
from ..operators.facets import best, facet_counts, ranked_lists
from ..operators.quantiles import merge_groups, quantiles

TOP = 5
TOP_COMPONENTS = 8

FACETS = {
    "session": "conversation_id",
    "component": "component_type",
    "tool": "tool_name",
    "mcp_tool": "mcp_tool",
    "model": "request_model",
    "error": "error_type",
}
LISTS = {
    "top_sessions": ("session", "count"),
    "failed_sessions": ("session", "failures"),
    "top_components": ("component", "count"),
    "failed_components": ("component", "failures"),
    "top_tools": ("tool", "count"),
    "top_models": ("model", "count"),
    "mcp_methods": ("tool", "count"),
    "mcp_tools": ("mcp_tool", "count"),
    "error_types": ("error", "count"),
}


def _scope(events: DataFrame, time_range: str, as_of, ts: str) -> DataFrame:
    return keep_external(events, "sanity").where(at_least(events, time_range, as_of, ts))


def scalars(events: DataFrame, time_range="now-24h", as_of=None, ts="ts", digits: bool = True, approx=False) -> DataFrame:
    """One row: documents, success and tool error rate, P50/P95, retry, token and cost totals."""
    rows = _scope(events, time_range, as_of, ts).withColumn("scope", F.lit("all"))
    with_tool = F.col("tool_name").isNotNull()
    found = quantiles(
        rows,
        ["scope"],
        "event_duration",
        {"p50": 0.5, "p95": 0.95},
        approx,
        measures={
            "documents": F.count(F.lit(1)),
            "failures": count_if(failed()),
            "tool_calls": count_if(with_tool),
            "tool_failures": count_if(failed() & with_tool),
            "retry_total": total("retry_count").cast("bigint"),
            "token_input_total": total("input_tokens"),
            "token_output_total": total("output_tokens"),
            "cost_total": total(money("cost")),
        },
    )
    named = found.select(
        "scope",
        "documents",
        (F.lit(1.0) - rate(F.col("failures"), F.col("documents"))).alias("success_rate"),
        rate(F.col("tool_failures"), F.col("tool_calls")).alias("tool_error_rate"),
        (F.col("p50") / F.lit(1e6)).alias("p50_latency_ms"),
        (F.col("p95") / F.lit(1e6)).alias("p95_latency_ms"),
        "retry_total",
        "token_input_total",
        "token_output_total",
        F.col("cost_total").cast("double").alias("cost_total"),
    )
    empty = rows.sparkSession.range(1).select(F.lit("all").alias("scope"))
    merged = merge_groups(["scope"], named, empty).drop("scope")
    shape = {"success_rate": 4, "tool_error_rate": 4, "p50_latency_ms": 2, "p95_latency_ms": 2}
    out = []
    for name in merged.columns:
        column = F.coalesce(F.col(name), F.lit(0).cast(merged.schema[name].dataType))
        out.append((fixed(column, shape[name]) if digits and name in shape else column).alias(name))
    return merged.select(*out)


def facets(events: DataFrame, time_range="now-24h", as_of=None, ts="ts") -> DataFrame:
    """Every top list in long form: ``list, rank, key, count``.

    ``mcp_methods`` ranks all tools, as the report always did; ``mcp_tools`` ranks
    only tools of MCP components.
    """
    rows = _scope(events, time_range, as_of, ts).withColumn(
        "mcp_tool", F.when(F.col("component_type") == "mcp", F.col("tool_name"))
    )
    counts = facet_counts(
        rows.select("event_outcome", *FACETS.values()), FACETS, failures=count_if(failed())
    )
    ranked = ranked_lists(counts, LISTS, TOP_COMPONENTS, positive=("failed_sessions", "failed_components"))
    limit = F.when(F.col("list").isin("top_components", "failed_components"), TOP_COMPONENTS).otherwise(TOP)
    return ranked.where(F.col("rank") <= limit).select("list", "rank", "key", "count")


def slow_turns(events: DataFrame, time_range="now-24h", as_of=None, ts="ts", size: int = TOP, by=()) -> DataFrame:
    """Turns by mean latency, with failures, dominant session and dominant component."""
    by = list(by)
    rows = _scope(events, time_range, as_of, ts)
    return turns_by_latency(rows, size, by)


def turns_by_latency(rows: DataFrame, size: int, by=()) -> DataFrame:
    """One scan: totals and the counts of both side keys come from the same grouped rows."""
    by = list(by)
    return turns_from_counts(turn_counts(rows, by), size, by)


def turn_counts(rows: DataFrame, by=()) -> DataFrame:
    """Rows, failures and latency per turn and session, and per turn and component."""
    by = list(by)
    sides = F.array(
        F.struct(F.lit("session").alias("side"), F.col("conversation_id").alias("key")),
        F.struct(F.lit("component").alias("side"), F.col("component_type").alias("key")),
    )
    return (
        rows.where(F.col("turn_id").isNotNull())
        .select(*by, "turn_id", "event_outcome", "latency_ms", F.explode(sides).alias("_s"))
        .groupBy(*by, "turn_id", F.col("_s.side").alias("side"), F.col("_s.key").alias("key"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_if(failed()).alias("failures"),
            F.sum(exact("latency_ms")).alias("latency"),
            F.count("latency_ms").alias("timed"),
        )
    )


def turns_from_counts(split: DataFrame, size: int, by=()) -> DataFrame:
    """The slowest turns out of ``turn_counts``."""
    by = list(by)

    def once(column: str):
        return F.sum(F.when(F.col("side") == "session", F.col(column)))

    def most(side: str):
        mine = (F.col("side") == side) & F.col("key").isNotNull()
        return F.min_by("key", F.when(mine, F.struct(-F.col("n"), F.col("key"))))

    turns = (
        split.groupBy(*by, "turn_id")
        .agg(
            once("n").alias("doc_count"),
            once("failures").alias("failure_count"),
            once("latency").alias("_latency"),
            once("timed").alias("_timed"),
            most("session").alias("session_id"),
            most("component").alias("component_type"),
        )
        .withColumn("avg_latency", average("_latency", "_timed"))
    )
    top = best(turns, "turn_id", "avg_latency", size, by)
    return top.select(
        *by,
        "turn_id",
        "doc_count",
        "failure_count",
        fixed(F.coalesce("avg_latency", F.lit(0.0)), 2).alias("avg_latency_ms"),
        "session_id",
        "component_type",
    )


def report(events: DataFrame, time_range="now-24h", as_of=None, ts="ts") -> DataFrame:
    """The whole report in long form: ``metric, rank, key, value, count, detail``."""
    numbers = scalars(events, time_range, as_of, ts)
    single = numbers.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers.columns])
        ).alias("m")
    ).select("m.metric", "m.value")
    lists = facets(events, time_range, as_of, ts).withColumnRenamed("list", "metric")
    turns = slow_turns(events, time_range, as_of, ts).select(
        F.lit("slow_turns").alias("metric"),
        F.col("turn_id").alias("key"),
        F.col("avg_latency_ms").alias("value"),
        F.col("doc_count").alias("count"),
        F.col("session_id").alias("detail"),
    )
    return (
        single.unionByName(lists, allowMissingColumns=True)
        .unionByName(turns, allowMissingColumns=True)
        .select("metric", "rank", "key", "value", "count", "detail")
    )
