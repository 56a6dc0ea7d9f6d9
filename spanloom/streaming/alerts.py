"""Alert check on every closed window of a stream.

The stream decides only *when*: a window that the watermark has passed triggers a
batch that reads the stored events of those windows and of the time before them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeframe import at_least, at_most
from ..plans import alerts
from ..session import cut


def closed_windows(stream: DataFrame, every: str = "15 minutes", delay: str = "5 minutes", ts: str = "ts") -> DataFrame:
    watched = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = watched.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events")


def window_snapshot(
    events: DataFrame, windows: DataFrame, every: str, baseline: str, rules: alerts.Rules = alerts.Rules(), by: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """The wide rows of the given windows. Only their span and one baseline before it is read."""
    span = windows.agg(
        F.date_format(F.min("window_start") - F.expr(f"INTERVAL {baseline}"), "yyyy-MM-dd HH:mm:ss").alias("low"),
        F.date_format(F.max("window_end"), "yyyy-MM-dd HH:mm:ss").alias("high"),
    ).first()
    before_end = F.col(ts) < F.lit(span.high).cast(events.schema[ts].dataType)
    near = events.where(at_least(events, span.low, ts=ts) & at_most(events, span.high, ts=ts) & before_end)
    wide = alerts.per_window(near, every, baseline, rules, by, ts=ts)
    asked = windows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("_start")).distinct()
    return wide.join(asked, F.substring_index("scope", "@", -1) == F.col("_start"), "left_semi")


def check_windows(
    events: DataFrame, windows: DataFrame, every: str, baseline: str, rules: alerts.Rules = alerts.Rules(), by: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Alerts of the given windows."""
    return alerts.analyze(window_snapshot(events, windows, every, baseline, rules, by, ts))


def watch(
    spark: SparkSession,
    stream: DataFrame,
    read_events: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    every: str = "15 minutes",
    baseline: str = "24 hours",
    rules: alerts.Rules = alerts.Rules(),
    by: Sequence[str] = (),
    delay: str = "5 minutes",
    interval: str | None = None,
    rows_out: str | None = None,
) -> StreamingQuery:
    """Write the alerts of each closed window below ``out``, and below ``rows_out`` their event rows.

    A quiet window has one event row that says so. A repeated batch overwrites its own folders, so a retry
    adds nothing twice.
    """

    def check(windows: DataFrame, batch: int) -> None:
        if windows.isEmpty():
            return
        wide = cut(window_snapshot(read_events(), windows, every, baseline, rules, by))
        found = alerts.analyze(wide)
        found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")
        if rows_out:
            alerts.alert_events(found, wide).write.mode("overwrite").parquet(f"{rows_out.rstrip('/')}/batch={batch}")

    writer = closed_windows(stream, every, delay).writeStream.outputMode("append").foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
