"""Activity sessions on a stream: rows of one conversation without a pause longer than a gap.

The state is one merging session per conversation that is still open; it is written once, when the watermark has passed its last
row by the gap. The same function answers for a stored table, where every session is closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import count_if, failed, total


def gap_of(default: str = "30 minutes", by_value: dict[str, str] | None = None, column: str = "service_name") -> Column | str:
    """One gap for all rows, or one per value of a column (the gap after a row is that of the row)."""
    if not by_value:
        return default
    chosen = F.lit(default)
    for value, gap in by_value.items():
        chosen = F.when(F.col(column) == value, F.lit(gap)).otherwise(chosen)
    return chosen


def session_activity(events: DataFrame, gap: Column | str = "30 minutes", delay: str = "10 minutes", key: str = "conversation_id", ts: str = "ts") -> DataFrame:
    """``key, session_start, session_end, rows, failures, retries, tokens_in, tokens_out`` per session.

    * ``session_end`` is the time of the last row; a row exactly one gap after it still belongs to the session.
    * rows without a key or a time belong to no session; a late row joins a session that is still open, and is
      dropped by a stream once the watermark has closed it.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, delay)
    rows = timed.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    grouped = rows.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(
        F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("rows"),
        count_if(failed()).alias("failures"),
        total("retry_count").cast("bigint").alias("retries"),
        total("input_tokens").cast("bigint").alias("tokens_in"),
        total("output_tokens").cast("bigint").alias("tokens_out"),
    )
    return grouped.select(key, F.col("w.start").alias("session_start"), "session_end", "rows", "failures", "retries", "tokens_in", "tokens_out")


def session_shape(sessions: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Per key: number of sessions, active seconds, the longest one and the longest pause between two."""
    seconds = F.unix_micros(F.col("session_end")) - F.unix_micros(F.col("session_start"))
    before = F.lag("session_end").over(Window.partitionBy(key).orderBy("session_start"))
    paused = sessions.withColumn("_pause", F.unix_micros(F.col("session_start")) - F.unix_micros(before))
    return paused.groupBy(key).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("rows").alias("rows"), F.sum(seconds).alias("active_us"), F.max(seconds).alias("longest_us"), F.max("_pause").alias("longest_pause_us")
    )
