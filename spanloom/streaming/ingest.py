"""Continuous ingest: landing folder -> normalised rows -> event table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize
from ..schema import PARTITION_COLUMN
from ..session import spread
from ..sources import feedback, files, otlp
from ..sources.events import conform

SOURCES = {
    "logs": otlp.read_logs,
    "traces": otlp.read_traces,
    "feedback": feedback.read_feedback,
    "files": files.read_log_files,
}

# The micro-batch cadence of the collector.
BATCH_INTERVAL = "5 seconds"
#: Tasks that the rows of one folder and batch are dealt to, so also the files it gets at most.
SLICES = 8
#: Up to so many partitions Spark writes a shuffle row by row (``spark.shuffle.sort.bypassMergeThreshold``); above, it first gathers rows in memory.
UNGATHERED = 200


def open_stream(spark: SparkSession, kind: str, path: str, max_files: int = 1000, **options) -> DataFrame:
    """New files of one kind as normalised event rows."""
    rows = SOURCES[kind](spark, path, stream=True, maxFilesPerTrigger=max_files)
    return normalize(rows, **options)


def drop_repeats(stream: DataFrame, keys: Sequence[str] | None = None, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Rows delivered twice within ``delay`` kept once; the watermark bounds the state.

    A repeat is a row equal in every column, so a span keeps all its logs. With ``keys``
    it is a row with the same keys, and rows without one of them pass untouched.
    Off by default: without it a late or repeated row simply lands.
    """
    watched = stream.withWatermark(ts, delay)
    if keys is None:
        content = F.sha2(F.to_json(F.struct("*")), 256)
        return watched.withColumn("_record", content).dropDuplicatesWithinWatermark(["_record"]).drop("_record")
    complete = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return watched.where(complete).dropDuplicatesWithinWatermark(list(keys)).unionByName(watched.where(~complete))


def dealt(stream: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows dealt by folder and a slice of their content.

    The sink sorts a task's rows by folder, and a row group of a landed file is one task however many rows it holds. Dealt, a task
    sorts a share of the batch.
    """
    content = [c for c, kind in stream.dtypes if "map<" not in kind]  # a map has no hash
    return stream.repartition(min(spread(stream.sparkSession), UNGATHERED), *partition_by, F.pmod(F.xxhash64(*content), F.lit(SLICES)))


def start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (PARTITION_COLUMN,),
    interval: str | None = None,
) -> StreamingQuery:
    """Append a stream of finished rows to a Parquet table.

    ``interval`` None works off what is there and stops. The checkpoint makes a
    restarted query go on where it stopped; the file sink commits each batch once.
    """
    stream = dealt(stream, partition_by) if partition_by else stream
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def ingest(spark: SparkSession, kind: str, landing: str, table: str, checkpoint: str, interval: str | None = BATCH_INTERVAL, **options):
    """The whole path for one kind of source."""
    rows = conform(open_stream(spark, kind, landing, **options))
    return start(rows, table, checkpoint, interval=interval)
