"""Top-N lists and many facets over one scan.

Everything is counted per key before it is ranked, and a ranked list is cut with
``row_number() <= n``, which Spark already applies in each map task, so a facet
with an unbounded number of keys never lands in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(
    df: DataFrame,
    key: str,
    size: int | None = 10,
    by: Sequence[str] = (),
    order: str = "count",
    **measures: Column,
) -> DataFrame:
    """Rows per value of ``key`` with further measures, the largest ``order`` first.

    Rows without a key are left out; ties go to the smaller key.
    """
    grouped = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("count"), *[column.alias(name) for name, column in measures.items()]
    )
    return best(grouped, key, order, size, by)


def best(df: DataFrame, key: str, order: str, size: int | None, by: Sequence[str] = ()) -> DataFrame:
    """The first ``size`` rows per ``by`` by ``order`` (nulls last), then by key."""
    ranking = [F.col(order).desc_nulls_last(), F.col(key).asc()]
    if size is None:
        return df.orderBy(*by, *ranking)
    if not by:
        return df.orderBy(*ranking).limit(size)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*ranking))
    return df.withColumn("rank", rank).where(F.col("rank") <= size)


def long_facets(df: DataFrame, facets: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, facet) with a key; the shape every facet measure starts from."""
    entries = F.array(
        *[F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("key")) for name, column in facets.items()]
    )
    return (
        df.select(*keep, F.explode(entries).alias("_f"))
        .select(*keep, "_f.facet", "_f.key")
        .where(F.col("key").isNotNull())
    )


def facet_counts(
    df: DataFrame, facets: Mapping[str, str], by: Sequence[str] = (), **measures: Column
) -> DataFrame:
    """All facets grouped in one pass: ``by, facet, key, count, measures``."""
    inputs = [c for c in df.columns if c not in by]
    return (
        long_facets(df, facets, [*by, *inputs])
        .groupBy(*by, "facet", "key")
        .agg(F.count(F.lit(1)).alias("count"), *[column.alias(name) for name, column in measures.items()])
    )


def ranked_lists(
    counts: DataFrame,
    lists: Mapping[str, tuple[str, str]],
    size: int,
    by: Sequence[str] = (),
    positive: Sequence[str] = (),
) -> DataFrame:
    """Cut several ranked lists out of one facet table.

    ``lists`` maps a list name to ``(facet, measure)``. Lists named in ``positive``
    hold only keys whose measure is above zero (a filter before the terms).
    Result: ``by, list, rank, key, count, value``.
    """
    choices = F.array(
        *[
            F.when(
                (F.col("facet") == facet) & ((F.col(measure) > 0) if name in positive else F.lit(True)),
                F.struct(
                    F.lit(name).alias("list"),
                    F.when(F.lit(name in positive), F.col(measure)).otherwise(F.col("count")).cast("bigint").alias("count"),
                    F.coalesce(F.col(measure).cast("double"), F.lit(0.0)).alias("value"),
                ),
            )
            for name, (facet, measure) in lists.items()
        ]
    )
    spread = (
        counts.select(*by, "key", F.explode(choices).alias("_l"))
        .where(F.col("_l").isNotNull())
        .select(*by, "key", "_l.list", "_l.count", "_l.value")
    )
    rank = F.row_number().over(
        Window.partitionBy(*by, "list").orderBy(F.col("value").desc(), F.col("key").asc())
    )
    return spread.withColumn("rank", rank).where(F.col("rank") <= size)


def dominant(counts: DataFrame, by: Sequence[str], key: str, count: str = "count", name: str | None = None) -> DataFrame:
    """The most frequent ``key`` per group (smallest on ties), from counts that may still be split."""
    per_key = counts.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.sum(count).alias("_c"))
    return per_key.groupBy(*by).agg(
        F.min_by(F.col(key), F.struct(-F.col("_c"), F.col(key))).alias(name or key)
    )
