"""Time buckets, span metrics and the stored metrics roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_if, total
from ..functions.timeframe import bucket
from .quantiles import quantiles

# Dimensions of the span metrics.
SPAN_METRIC_DIMENSIONS = ("service_name", "tool_name", "request_model", "event_outcome")

# Upper edges of the duration histogram, in milliseconds.
DURATION_EDGES_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)


def ordered_dimensions(dimensions: Sequence[str] | None) -> list[str]:
    """Dimension names without blanks and repeats, in the order given."""
    return list(dict.fromkeys(d.strip() for d in (dimensions or SPAN_METRIC_DIMENSIONS) if d and d.strip()))


def date_histogram(
    df: DataFrame, interval: str, split: Sequence[str] = (), ts: str = "ts", **measures: Column
) -> DataFrame:
    """Measures per time bucket, optionally split by further columns.

    Grouped by the window itself, which keeps the watermark of a stream.
    """
    grouped = df.groupBy(F.window(ts, interval).alias("_w"), *split).agg(
        *[column.alias(name) for name, column in measures.items()]
    )
    return grouped.select(F.col("_w.start").alias("bucket"), *split, *measures)


def percentile_histogram(
    df: DataFrame, interval: str, value: str | Column, probs, ts: str = "ts", approx: bool = False
) -> DataFrame:
    return quantiles(df.withColumn("bucket", bucket(df, interval, ts)), ["bucket"], value, probs, approx)


def duration_edges(value: Column) -> dict[str, Column]:
    """Cumulative histogram counts, one column per upper edge."""
    return {f"le_{edge}": count_if(value <= F.lit(edge * 1_000_000)) for edge in DURATION_EDGES_MS}


def span_metrics(
    df: DataFrame,
    interval: str,
    dimensions: Sequence[str] | None = None,
    ts: str = "ts",
    sketch: bool = False,
) -> DataFrame:
    """Calls and duration per time bucket and dimensions.

    Every column is additive (or, with ``sketch``, mergeable), so the roll-up can be
    stored and summed again over longer windows.
    """
    duration = F.col("event_duration")
    measures = {
        "calls": F.count(F.lit(1)),
        "duration_count": F.count(duration),
        "duration_sum": total(duration),
        "retries": total("retry_count").cast("bigint"),
        "tokens_in": total("input_tokens"),
        "tokens_out": total("output_tokens"),
        **duration_edges(duration),
    }
    if sketch:
        measures["duration_sketch"] = F.kll_sketch_agg_bigint(duration)
    return date_histogram(df, interval, ordered_dimensions(dimensions), ts, **measures)


def roll_up(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum stored span metrics over the dimensions left out."""
    additive = [c for c in metrics.columns if c in ("calls", "duration_count", "duration_sum", "retries", "tokens_in", "tokens_out") or c.startswith("le_")]
    parts = [F.sum(c).alias(c) for c in additive]
    if "duration_sketch" in metrics.columns:
        parts.append(F.kll_merge_agg_bigint("duration_sketch").alias("duration_sketch"))
    return metrics.groupBy(*by).agg(*parts)


def distinct_sketches(
    df: DataFrame, interval: str, columns: Sequence[str], dimensions: Sequence[str] = (), ts: str = "ts", lg_k: int = 14
) -> DataFrame:
    """Distinct values per time bucket and dimensions as mergeable sketches, ``<column>_sketch``: a count distinct that can be stored and rolled up.

    Nulls do not count. A sketch takes at most 2**lg_k bytes; estimates of few hundred values are exact, of more off by
    ``distinct_error(lg_k)`` at three standard deviations.
    """
    return date_histogram(df, interval, dimensions, ts, **{f"{c}_sketch": F.hll_sketch_agg(F.col(c).cast("string"), lg_k) for c in columns})


def distinct_counts(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values over everything that was sketched, per group: a union of sketches, no value is read again."""
    found = [c for c in sketches.columns if c.endswith("_sketch")]
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c.removesuffix("_sketch")) for c in found])


def distinct_error(lg_k: int = 14) -> float:
    """Relative error of an estimate at three standard deviations."""
    return 3 * 1.04 / 2 ** (lg_k / 2)
