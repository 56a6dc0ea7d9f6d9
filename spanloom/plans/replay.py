"""Session and trace replay: the span forest of every scope, and its text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.forest import forest, last_per_span
from ..operators.tour import tour

# Fields of a replayed node.
NODE_FIELDS = {
    "parent_id": "parent_id",
    "ts": "timestamp",
    "event_action": "action",
    "event_outcome": "outcome",
    "tool_name": "tool",
    "request_model": "model",
    "component_type": "component",
    "turn_id": "turn_id",
    "latency_ms": "latency_ms",
    "event_duration": "duration_ns",
    "message": "message",
    "reasoning_action": "reasoning_action",
    "reasoning_decision_type": "reasoning_type",
    "reasoning_rationale": "reasoning_rationale",
    "reasoning_confidence": "reasoning_confidence",
    "reasoning_alternatives": "reasoning_alternatives",
    "feedback_score": "feedback_score",
    "feedback_sentiment": "feedback_sentiment",
    "agent_name": "agent_name",
    "agent_id": "agent_id",
}
_TYPES = {
    "timestamp": "timestamp", "latency_ms": "double", "duration_ns": "bigint", "reasoning_confidence": "double",
    "feedback_score": "double",
}


def _with_spans(rows: DataFrame) -> DataFrame:
    """Rows without a span get an id of their own: their content's hash, and a number among equal rows.

    The ids are the same whichever executor computes them.
    """
    blank = F.coalesce(F.col("span_id"), F.lit("")) == ""
    bare = rows.where(blank).withColumn("_hash", F.sha2(F.to_json(F.struct("*")), 256))
    number = F.row_number().over(Window.partitionBy("_hash").orderBy("_hash"))
    named = bare.withColumn("span_id", F.concat(F.lit("_evt_"), F.col("_hash"), F.lit("_"), number.cast("string"))).drop("_hash")
    return rows.where(~blank).unionByName(named)


def _shaped(events: DataFrame, scope: str) -> DataFrame:
    rows = events.where(F.col(scope).isNotNull())
    rows = _with_spans(rows)
    step = F.col("reasoning_step_index") if "reasoning_step_index" in events.columns else F.lit(None).cast("int")
    picked = [
        (F.col(source) if source in events.columns else F.lit(None).cast(_TYPES.get(name, "string"))).alias(name)
        for source, name in NODE_FIELDS.items()
    ]
    return rows.select(
        F.col(scope).alias("scope"), "span_id", *picked, F.coalesce(step, F.lit(2147483647)).alias("step")
    )


def _last(shaped: DataFrame, payload: list[str]) -> DataFrame:
    return last_per_span(shaped, "scope", [F.col("timestamp"), F.col("step"), F.col("span_id")], payload)


def nodes(events: DataFrame, scope: str = "trace_id") -> DataFrame:
    """One node per span of a scope; a repeated span id keeps its last row.

    ``events`` counts the rows behind a node. Every row without a span id is a node of
    its own.
    """
    return _last(_shaped(events, scope), list(NODE_FIELDS.values()))


def replay(events: DataFrame, scope: str = "trace_id") -> DataFrame:
    """Every reachable node with depth, root and pre-order path.

    The forest is built from the edges alone; the node fields join it once. A path is as long as the tree is
    deep: for chains of thousands of spans take ``toured``.
    """
    shaped = _shaped(events, scope)
    placed = forest(_last(shaped, ["parent_id"]), "scope")
    return _last(shaped, list(NODE_FIELDS.values())).join(placed, ["scope", "span_id"])


def toured(events: DataFrame, scope: str = "trace_id") -> DataFrame:
    """Every reachable node with depth, root, pre-order place and what its subtree holds; for trees of any depth.

    ``events``, ``failures`` and ``latency`` (milliseconds, a decimal) are sums over the subtree, the node included. The nodes of a subtree
    are those of its scope with places ``pre`` to ``last``, so a listing or a cut of a tree is a range of one column.
    """
    found = _last(_shaped(events, scope), ["parent_id", "outcome", "latency_ms"])
    edges = found.select(
        "scope", "span_id", "parent_id", "place", F.col("place.timestamp").alias("_at"), F.col("events").cast("bigint").alias("events"),
        F.when(F.col("outcome") == "failure", 1).otherwise(0).cast("bigint").alias("failures"), F.col("latency_ms").cast("decimal(38,6)").alias("latency"),
    )
    return tour(edges, "scope", at="_at", weights=["events", "failures", "latency"])


def replay_one(events: DataFrame, session_id: str = "", trace_id: str = "", max_events: int | None = None) -> DataFrame:
    """Tree of one session (it takes precedence) or one trace, in print order."""
    if not session_id and not trace_id:
        raise ValueError("give a session id or a trace id")
    column, value = ("conversation_id", session_id) if session_id else ("trace_id", trace_id)
    step = [F.col("reasoning_step_index").asc_nulls_last()] if "reasoning_step_index" in events.columns else []
    rows = events.where(F.col(column) == value).orderBy("ts", *step, F.col("span_id").asc_nulls_last())
    rows = rows if max_events is None else rows.limit(max_events)
    return in_order(replay(rows, column))


def stats(events: DataFrame, scope: str = "trace_id") -> DataFrame:
    """Events and root spans per scope; one pass over the edges, no tree needed."""
    found = _last(_shaped(events, scope), ["parent_id"])
    known = found.select(F.col("scope").alias("_s"), F.col("span_id").alias("_known"))
    linked = found.join(known, (F.col("scope") == F.col("_s")) & (F.col("parent_id") == F.col("_known")), "left")
    return linked.groupBy("scope").agg(
        F.sum("events").alias("total_events"), F.count(F.when(F.col("_known").isNull(), 1)).alias("root_count")
    )


def in_order(tree: DataFrame) -> DataFrame:
    """Pre-order listing; a range sort on scope and path splits a large scope."""
    return tree.orderBy("scope", "path")


def _shown(value: Column, text: Column) -> Column:
    """``text`` when ``value`` is set and not empty."""
    return F.when(value.isNotNull() & (value != ""), text)


def _milliseconds() -> Column:
    latency = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    duration = F.when(F.col("duration_ns") != 0, F.col("duration_ns") / F.lit(1e6))
    whole = F.bround(F.coalesce(latency, duration)).cast("bigint").cast("string")
    return F.concat(whole, F.lit("ms"))


def lines(tree: DataFrame) -> DataFrame:
    """Text of each node: main line, reasoning, rationale, feedback and message, indented by depth."""
    # Marks and layout of a printed tree.
    indent = F.repeat(F.lit("  "), F.col("depth"))
    mark = F.when(F.col("outcome") == "success", "✓").when(F.col("outcome") == "failure", "✗").otherwise("·")

    def tagged(name: str, column: str) -> Column:
        return _shown(F.col(column).cast("string"), F.concat(F.lit(f"{name}="), F.col(column).cast("string")))

    main = F.concat(
        indent,
        F.concat_ws(
            " ",
            mark,
            F.concat(F.lit("["), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("]")),
            F.nullif("action", F.lit("")),
            _shown(F.col("component"), F.concat(F.lit("("), F.col("component"), F.lit(")"))),
            tagged("tool", "tool"),
            tagged("model", "model"),
            tagged("agent", "agent_name"),
            _milliseconds(),
        ),
    )
    decided = F.col("reasoning_action").isNotNull() & (F.col("reasoning_action") != "")
    reasoning = F.when(
        decided,
        F.concat(
            indent,
            F.concat_ws(
                " ",
                F.lit("  💭"),
                tagged("decided", "reasoning_action"),
                tagged("type", "reasoning_type"),
                tagged("conf", "reasoning_confidence"),
                _shown(F.col("reasoning_alternatives"), F.concat(F.lit("rejected=["), F.col("reasoning_alternatives"), F.lit("]"))),
            ),
        ),
    )
    rationale = F.when(
        decided, _shown(F.col("reasoning_rationale"), F.concat(indent, F.lit("  📝 "), F.col("reasoning_rationale")))
    )
    feedback = F.when(
        F.col("feedback_score").isNotNull() | (F.col("feedback_sentiment") != ""),
        F.concat(indent, F.concat_ws(" ", F.lit("  👤"), tagged("score", "feedback_score"), tagged("sentiment", "feedback_sentiment"))),
    )
    message = F.when(
        ~F.coalesce(F.col("action"), F.lit("")).isin("otlp.log", "otlp.span"),
        _shown(F.col("message"), F.concat(indent, F.lit("  → "), F.replace(F.col("message"), F.lit("\n"), F.lit(" ")))),
    )
    return tree.select(
        "scope", "path", "span_id", "depth", F.concat_ws("\n", main, reasoning, rationale, feedback, message).alias("text")
    )
