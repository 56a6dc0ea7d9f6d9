"""Row predicates: severity floor, whole-trace sampling and the saved searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import failed

# Lowest number of each severity band.
SEVERITY = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}


def min_severity(logs: DataFrame, level: str, number: str = "severity_number") -> DataFrame:
    """Drop log records below ``level``; ``TRACE`` or an empty level keeps all."""
    level = (level or "").upper()
    if level in ("", "TRACE"):
        return logs
    floor = F.lit(SEVERITY[level])
    return logs.where(~F.coalesce(F.col(number) < floor, F.lit(False)))


def trace_share(trace: Column) -> Column:
    """A trace's place in 0..1, the same for all its rows and on every engine."""
    head = F.conv(F.substring(F.md5(trace.cast("string")), 1, 8), 16, 10).cast("bigint")
    return head.cast("double") / F.lit(float(1 << 32))


def sample_traces(spans: DataFrame, ratio: float, trace: str = "trace_id") -> DataFrame:
    """Keep about ``ratio`` of all traces, each with all of its spans."""
    if not 0.0 < ratio < 1.0:
        return spans
    return spans.where(trace_share(F.col(trace)) < F.lit(float(ratio)))


def has_failure() -> Column:
    return F.coalesce(failed(), F.lit(False)) | F.col("ingest_error").isNotNull()


def in_session() -> Column:
    return F.col("conversation_id").isNotNull() | F.col("turn_id").isNotNull() | F.col("agent_id").isNotNull()


def in_trace() -> Column:
    return F.col("trace_id").isNotNull()
