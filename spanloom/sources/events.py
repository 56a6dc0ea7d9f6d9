"""The stored event table: scan, append and report output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeframe import at_least, at_most
from ..operators.normalize import typed_columns
from ..schema import PARTITION_COLUMN, event_schema

# Rows per file; with one folder per day this is the roll-over rule.
ROWS_PER_FILE = 50_000_000


def scan(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, as_of=None) -> DataFrame:
    """Stored events, pruned to the days of the range."""
    schema = event_schema().add(PARTITION_COLUMN, "date")
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    if since:
        rows = rows.where(at_least(rows, since, as_of))
    if until:
        rows = rows.where(at_most(rows, until, as_of))
    return rows


def conform(df: DataFrame) -> DataFrame:
    """Every schema column, missing ones empty, plus the day it is stored under."""
    return df.selectExpr(*typed_columns(df.columns)).withColumn(PARTITION_COLUMN, F.to_date("ts"))


def append(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Append rows of any plan (ingest, alerts, evaluations, audits) to the table.

    The rebalance hint collects each day's rows into files of the advisory size and
    splits a day that is too large for one task.
    """
    (
        conform(df)
        .hint("rebalance", PARTITION_COLUMN)
        .write.mode("append")
        .partitionBy(PARTITION_COLUMN)
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .parquet(path)
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Span metrics to their own table, by day of the bucket."""
    (
        metrics.withColumn("bucket_date", F.to_date("bucket"))
        .hint("rebalance", "bucket_date")
        .write.mode("append")
        .partitionBy("bucket_date")
        .parquet(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def audit_events(runs: DataFrame) -> DataFrame:
    """Audit rows (``tool, verdict, duration_ms, inputs, evidence``) as events to append."""

    def optional(name: str, kind: str):
        return F.col(name).cast(kind) if name in runs.columns else F.lit(None).cast(kind)

    return runs.select(
        (F.col("ts") if "ts" in runs.columns else F.current_timestamp()).alias("ts"),
        F.lit("event").alias("event_kind"),
        F.lit("process").alias("event_category"),
        F.lit("skill_run").alias("event_action"),
        # Verdicts that count as success.
        F.when(F.col("verdict").isin("ok", "healthy", "ready", "passed"), "success").otherwise("failure").alias("event_outcome"),
        F.lit("internal.skill_audit").alias("event_dataset"),
        F.lit("spanloom").alias("service_name"),
        F.lit("skill_audit").alias("operation_name"),
        F.col("tool").alias("tool_name"),
        F.col("verdict").alias("audit_verdict"),
        optional("duration_ms", "double").alias("audit_duration_ms"),
        optional("inputs", "map<string,string>").alias("audit_inputs"),
        optional("evidence", "map<string,string>").alias("audit_evidence"),
    )
