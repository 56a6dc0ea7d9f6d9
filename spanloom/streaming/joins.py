"""Two streams side by side: feedback with the traces it is about, canaries with the rows that landed.

Both sides carry a watermark and the join a range of times, so a row waits in the state until its partner may no longer come: then
it is written alone, once. A row delivered twice within the delay counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.health import CANARY_DATASET, canary_verdicts


def _watched(rows: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
    return timed.withWatermark(ts, delay) if rows.isStreaming else timed


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def feedback_with_traces(feedback: DataFrame, traces: DataFrame, before: str = "1 day", after: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Every feedback row that names a trace, beside the root span of that trace; null columns where none came.

    ``feedback``: ``feedback_id, ts, trace_id, feedback_score``; ``traces``: rows of events with ``trace_id``,
    ``span_id``, ``parent_id``, ``ts``, ``event_action``, ``event_outcome``, ``event_duration``.

    * a root is a span without parent; it counts if it began within ``before`` ahead of the feedback or ``after`` behind it.
    * a trace with several roots gives a row for each; a feedback row or root delivered again gives none.
    * rows without a trace id or a time take no part (a session has no root; ``sources.feedback.feedback_on`` counts those).
    """
    said = _once(_watched(feedback.select("feedback_id", "ts", "trace_id", "feedback_score"), delay).where("trace_id IS NOT NULL"), ["feedback_id"])
    roots = traces.where("trace_id IS NOT NULL AND coalesce(parent_id, '') = ''")
    roots = _watched(roots.select(F.col("ts").alias("root_ts"), F.col("trace_id").alias("_trace"), F.col("span_id").alias("root"), "event_action", "event_outcome", "event_duration"), delay, "root_ts")
    roots = _once(roots, ["_trace", "root"])
    near = F.expr(f"trace_id = _trace AND root_ts >= ts - INTERVAL {before} AND root_ts <= ts + INTERVAL {after}")
    return said.join(roots, near, "left").drop("_trace")


def canaries_landed(sent: DataFrame, events: DataFrame, within: str = "15 minutes", delay: str = "10 minutes", dataset: str = CANARY_DATASET) -> DataFrame:
    """``verify_id``, ``verdict`` and ``missing`` of every sent canary (``verify_id, ts, send_ok, status_code``).

    * a canary counts as landed if its row's time is not before the sending and at most ``within`` later.
    * one that was not landed by then is written as soon as the watermark says so.
    * a canary or row delivered again counts once; rows without an id or a time take no part.
    """
    out = _once(_watched(sent.where("verify_id IS NOT NULL"), delay), ["verify_id"]).withColumnRenamed("ts", "sent_at")
    back = events.where("verify_id IS NOT NULL").select(F.col("ts").alias("landed_at"), F.col("verify_id").alias("_id"), F.struct("event_dataset", "service_name").alias("_l"))
    back = _once(_watched(back, delay, "landed_at"), ["_id"])
    near = F.expr(f"verify_id = _id AND landed_at >= sent_at AND landed_at <= sent_at + INTERVAL {within}")
    joined = out.join(back, near, "left")
    return canary_verdicts(joined, dataset)
