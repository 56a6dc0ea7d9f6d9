"""Freshness, field coverage, health verdicts, canary reconciliation and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import count_if, fixed, keep_external
from ..functions.timeframe import at_least
from ..operators.facets import terms
from ..schema import COVERAGE_TIERS, DOTTED, PARTITION_COLUMN, event_schema
from ..session import cut

WEIGHTS = {2: 2, 3: 1}


def _real(events: DataFrame, minutes: int, as_of) -> DataFrame:
    return keep_external(events, "all").where(at_least(events, f"now-{minutes}m", as_of))


def top_services(events: DataFrame, minutes: int = 10, as_of=None, size: int = 5) -> DataFrame:
    return terms(_real(events, minutes, as_of), "service_name", size)


def freshness(events: DataFrame, minutes: int = 10, as_of=None) -> DataFrame:
    """One row: real rows of the last minutes; none at all is a failure."""
    return _real(events, minutes, as_of).agg(
        F.count(F.lit(1)).alias("doc_count"), F.max("ts").alias("last_seen")
    ).select(F.when(F.col("doc_count") > 0, "pass").otherwise("fail").alias("status"), "doc_count", "last_seen")


def freshness_by_service(events: DataFrame, minutes: int = 10, as_of=None, known_since: str = "now-30d") -> DataFrame:
    """The same per service seen since ``known_since``, so that a silent service fails."""
    recent = at_least(events, f"now-{minutes}m", as_of)
    return (
        keep_external(events, "all")
        .where(at_least(events, known_since, as_of) & F.col("service_name").isNotNull())
        .groupBy("service_name")
        .agg(count_if(recent).alias("doc_count"), F.max("ts").alias("last_seen"))
        .withColumn("status", F.when(F.col("doc_count") > 0, "pass").otherwise("fail"))
    )


def coverage(events: DataFrame, minutes: int = 10, as_of=None, by: Sequence[str] = ()) -> DataFrame:
    """One row per scored field: rows that carry it, their share, tier and weight."""
    counts = _real(events, minutes, as_of).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(name).alias(name) for name in COVERAGE_TIERS]
    )
    entries = F.array(
        *[
            F.struct(F.lit(DOTTED[name]).alias("field"), F.lit(tier).alias("tier"), F.col(name).alias("doc_count"))
            for name, tier in COVERAGE_TIERS.items()
        ]
    )
    return counts.select(*by, "total", F.explode(entries).alias("e")).select(
        *by,
        "e.field",
        "e.tier",
        "e.doc_count",
        "total",
        fixed(F.try_divide(F.col("e.doc_count").cast("double"), F.col("total").cast("double")), 3).alias("coverage"),
        (F.col("e.doc_count") > 0).alias("present"),
    )


def coverage_score(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted share of present fields; a missing tier-2 field is a warning, no rows too."""
    weight = F.when(F.col("tier") == 2, WEIGHTS[2]).otherwise(WEIGHTS[3])
    earned = F.sum(F.when(F.col("present"), weight).otherwise(0)).cast("double")
    return (
        fields.groupBy(*by)
        .agg(
            F.max("total").alias("total_docs"),
            fixed(earned / F.sum(weight).cast("double"), 2).alias("score"),
            count_if(~F.col("present") & (F.col("tier") == 2)).alias("tier2_missing"),
            count_if(~F.col("present") & (F.col("tier") == 3)).alias("tier3_missing"),
        )
        .withColumn("status", F.when((F.col("tier2_missing") > 0) | (F.col("total_docs") == 0), "warn").otherwise("pass"))
    )


# Checks of the data plane, and the one that never degrades a verdict.
DATA_PLANE = ("processes_and_ports", "recent_data", "canary")
INFORMATIONAL = "instrumentation_coverage"
PATHS = ("bridge", "collector")


def verdict(checks: DataFrame, by: str = "scope") -> DataFrame:
    """One verdict per scope from rows ``(scope, check, status)``.

    Path states are given as checks ``bridge`` and ``collector`` with status ``up``,
    ``down`` or ``partial``; a store that cannot be asked as ``recent_data``/``unreachable``.
    """

    def any_row(condition: Column) -> Column:
        return F.coalesce(F.max(condition), F.lit(False))

    def has(check: str, *statuses: str) -> Column:
        return any_row((F.col("check") == check) & F.col("status").isin(*statuses))

    counted = ~F.col("check").isin(INFORMATIONAL, *PATHS)
    ladder = (
        F.when(has("recent_data", "unreachable"), "unreachable")
        .when(any_row(F.col("check").isin(*DATA_PLANE) & (F.col("status") == "fail")), "broken")
        .when(
            has("bridge", "up") & has("collector", "down", "partial") & has("recent_data", "pass") & has("canary", "pass", "skipped"),
            "degraded_collector_path",
        )
        .when(any_row(counted & ~F.col("status").isin("pass", "skipped")), "degraded")
        .otherwise("healthy")
    )
    return checks.groupBy(by).agg(ladder.alias("verdict"))


CANARY_DATASET = "internal.pipeline_verify"


def canaries(sent: DataFrame, events: DataFrame, dataset: str = CANARY_DATASET) -> DataFrame:
    """Verdict per sent canary (``verify_id, send_ok, status_code``) from what arrived."""
    landed = (
        events.where(F.col("verify_id").isNotNull())
        .groupBy("verify_id")
        .agg(F.max_by(F.struct("event_dataset", "service_name"), "ts").alias("_l"))
    )
    return canary_verdicts(sent.join(landed, "verify_id", "left"), dataset)


def canary_verdicts(joined: DataFrame, dataset: str = CANARY_DATASET) -> DataFrame:
    """The same of canaries that stand beside what landed, a struct ``_l`` or null."""
    arrived = F.col("_l").isNotNull()
    dataset_ok = F.coalesce(F.col("_l.event_dataset") == dataset, F.lit(False))
    service_ok = F.coalesce(F.col("_l.service_name") != "", F.lit(False))
    return joined.select(
        "verify_id",
        F.when(~F.col("send_ok"), F.when(F.col("status_code").isNull(), "transport_unreachable").otherwise("transport_rejected"))
        .when(arrived & dataset_ok & service_ok, "ok")
        .when(arrived, "contract_broken")
        .otherwise("sent_but_lost")
        .alias("verdict"),
        F.when(
            F.col("send_ok") & arrived,
            F.concat_ws(", ", F.when(~dataset_ok, "event.dataset"), F.when(~service_ok, "service.name")),
        ).alias("missing"),
    )


def canary_summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("verdict").agg(F.count(F.lit(1)).alias("canaries"))


def retention_ages(days: int) -> dict[str, int]:
    """Age in days at which a day of data becomes warm, cold and is dropped."""
    warm = max(1, days // 5)
    return {"warm": warm, "cold": max(warm + 1, days // 2), "delete": days}


def retention(events: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """Rows and tier per stored day; ``hot`` days are still written to."""
    ages = retention_ages(days)
    today = (F.current_date() if as_of is None else F.to_date(F.lit(str(as_of))))
    day = F.col(PARTITION_COLUMN) if PARTITION_COLUMN in events.columns else F.to_date("ts")
    age = F.date_diff(today, F.col("day"))
    tier = (
        F.when(age >= ages["delete"], "delete").when(age >= ages["cold"], "cold").when(age >= ages["warm"], "warm").otherwise("hot")
    )
    return events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("rows")).select("day", "rows", age.alias("age_days"), tier.alias("tier"))


def expire(spark: SparkSession, path: str, days: int = 30, as_of=None) -> DataFrame:
    """Remove the days of a stored table that are past retention; returns what each removed day held.

    A day is a partition folder, so it is removed whole, through the file system the path belongs to.
    """
    schema = event_schema().add(PARTITION_COLUMN, "date")
    stored = spark.read.schema(schema).option("basePath", path).parquet(path)
    gone = cut(retention(stored, days, as_of).where("tier = 'delete' AND day IS NOT NULL"))
    jvm = spark._jvm
    for row in gone.select(F.date_format("day", "yyyy-MM-dd").alias("day")).toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{PARTITION_COLUMN}={row['day']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def compact(events: DataFrame, target: str) -> None:
    """Write the given days again with few large files, into another folder."""
    (
        events.hint("rebalance", PARTITION_COLUMN)
        .write.mode("errorifexists")
        .partitionBy(PARTITION_COLUMN)
        .option("compression", "zstd")
        .parquet(target)
    )
