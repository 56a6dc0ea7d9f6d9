"""Windowed metrics on a stream: a window is written once, when the watermark has passed it, or live, whenever it changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.histogram import span_metrics


def _watched(stream: DataFrame, delay: str, ts: str) -> DataFrame:
    # a watermark needs a timestamp with a zone
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_metrics(
    stream: DataFrame, interval: str = "1 minute", dimensions: Sequence[str] | None = None, delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Span metrics per closed window, the same columns as the batch roll-up."""
    return span_metrics(_watched(stream, delay, ts), interval, dimensions, ts)


def stream_event_rate(stream: DataFrame, interval: str = "1 minute", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    rows = _watched(stream, delay, ts).where(F.col("event_outcome").isNotNull())
    return (
        rows.groupBy(F.window(ts, interval).alias("w"), "event_outcome")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("bucket"), "event_outcome", "count")
    )


def keep_live(
    stream: DataFrame, path: str, checkpoint: str, interval: str = "1 minute", dimensions: Sequence[str] | None = None, delay: str = "10 minutes",
    ts: str = "ts", trigger: str | None = None,
) -> StreamingQuery:
    """Write every window below ``path`` as often as a batch changes it, also while it is open.

    A batch has a folder of its own, overwritten when it is repeated; ``read_live`` takes the last state of each window.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    writer = stream_metrics(stream, interval, dimensions, delay, ts).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


def read_live(spark: SparkSession, path: str, dimensions: Sequence[str]) -> DataFrame:
    """The metrics that ``keep_live`` wrote, one row per window and dimensions; open windows as they were last."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("bucket", "batch", *dimensions)]
    last = rows.groupBy("bucket", *dimensions).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select("bucket", *dimensions, "_last.*")
