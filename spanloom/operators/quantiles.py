"""Percentiles per group, exact without gathering a group in one task.

Two column-pruned passes. The first counts rows per logarithmic value bucket (a
map-side combine, so a hot group shuffles only its buckets) and finds the bucket
that holds each wanted rank. The second reads only rows of those buckets, counts
them per distinct value and picks the ranks by running total. A bucket spans a
factor of about 1.001 at any magnitude, also below one, so the sorted part stays a sliver of the group whatever
the group's size; equal values collapse into one row before any sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut, small_side

BUCKETS_PER_E = 1024


def value_bucket(value: Column) -> Column:
    """Number of the logarithmic bucket of a value; buckets are in the order of their values."""
    # powers of e are offset so that every magnitude a double has keeps the order of its sign
    size = F.floor((F.log(F.abs(value)) + F.lit(800.0)) * F.lit(BUCKETS_PER_E)).cast("bigint")
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, size).otherwise(-size)


def _approximate(df: DataFrame, by: Sequence[str], value: Column, probs: Mapping[str, float], accuracy: int):
    return df.groupBy(*by).agg(
        *[F.percentile_approx(value, p, accuracy).cast("double").alias(name) for name, p in probs.items()]
    )


def _position(p: float) -> Column:
    return (F.col("_n") - 1) * F.lit(float(p))


def _holding(counted: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """The buckets that hold a wanted rank, of rows ``keys, _b, _c``; with the rows before them and in all."""
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.select(
        *keys,
        "_b",
        (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.sum("_c").over(running).alias("_upto"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"),
    )
    wanted = F.lit(False)
    for p in probs.values():
        for edge in (F.floor(_position(p)), F.ceil(_position(p))):
            wanted = wanted | ((edge >= F.col("_before")) & (edge < F.col("_upto")))
    return ends.where(wanted)


def _picked(near: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Interpolated percentiles from the distinct values (``_v``, ``_c`` times) of the buckets that hold them."""
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = near.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))

    def at(edge: Column) -> Column:
        hit = (edge < F.col("_upto")) & (edge >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(hit, F.col("_v"))).cast("double")

    ends = {name: (F.floor(_position(p)), F.ceil(_position(p))) for name, p in probs.items()}
    picked = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[at(e).alias(f"_{side}_{name}") for name, both in ends.items() for side, e in zip(("lo", "hi"), both)]
    )
    between = {n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (_position(p) - F.floor(_position(p))) for n, p in probs.items()}
    return picked.select(*keys, *[column.alias(name) for name, column in between.items()])


def counted_quantiles(values: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Percentiles per group of values that are counted already (``_v``, ``_c`` times; a value may come in several rows)."""
    by = list(by)
    known = values.select(*by, "_v", "_c", value_bucket(F.col("_v")).alias("_b"))
    targets = _holding(known.groupBy(*by, "_b").agg(F.sum("_c").alias("_c")), by, probs).drop("_c")
    near = known.join(targets, [*by, "_b"]).groupBy(*by, "_b", "_v", "_before", "_n").agg(F.sum("_c").alias("_c"))
    return _picked(near, by, probs)


def opened_buckets(near: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Percentiles from the counted values of the buckets that hold them: ``by, _b, _v, _c, _before`` (rows below the bucket), ``_n`` (rows in all)."""
    return _picked(near, list(by), probs)


def _sliding_ranks(key: str, every: int, steps: int, probs: Sequence[float]):
    """For the windows of one stretch of time: the buckets that hold the wanted ranks of the ``steps`` windows before each.

    Counts per bucket slide along: what enters is added, what leaves is taken off, so a cell is touched twice however long the reach.
    """

    def work(group: pd.DataFrame) -> pd.DataFrame:
        cells, asked = group[group["_b"].notna()].sort_values("_at"), np.unique(group[group["_b"].isna()]["_at"].to_numpy(np.int64))
        buckets, place = np.unique(cells["_b"].to_numpy(np.int64), return_inverse=True)
        at, count = cells["_at"].to_numpy(np.int64), cells["_c"].to_numpy(np.int64)
        entered, left = np.searchsorted(at, asked, side="left"), np.searchsorted(at, asked - steps * every, side="left")
        held, out, first, last = np.zeros(len(buckets), np.int64), [], 0, 0
        for window, upto, gone in zip(asked.tolist(), entered.tolist(), left.tolist()):
            np.add.at(held, place[last:upto], count[last:upto])
            np.subtract.at(held, place[first:gone], count[first:gone])
            first, last = gone, upto
            running = np.cumsum(held)
            n = int(running[-1]) if len(running) else 0
            edges = {edge for p in probs for edge in (math.floor((n - 1) * p), math.ceil((n - 1) * p))} if n else set()
            for k in {int(np.searchsorted(running, edge, side="right")) for edge in edges}:
                out.append((window, int(buckets[k]), int(running[k] - held[k]), n))
        found = pd.DataFrame(out, columns=["_start", "_b", "_before", "_n"], dtype="int64")
        found.insert(0, key, group[key].iloc[0])
        return found

    return work


def sliding_quantiles(rows: DataFrame, by: str, start: str, value: str, every: int, reach: int, probs: Mapping[str, float]) -> DataFrame:
    """Percentiles of the rows ``every`` to ``reach`` seconds before each window; exact. Rows carry their tumbling window's ``start`` in seconds."""
    values = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(start).alias("_at"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return sliding_counted(values, rows.select(by, F.col(start).alias("_at")).distinct(), by, start, every, reach, probs)


def sliding_counted(values: DataFrame, windows: DataFrame, by: str, start: str, every: int, reach: int, probs: Mapping[str, float]) -> DataFrame:
    """The same of values counted per window already (``by, _at, _v, _c``), for the given ``windows`` (``by, _at``).

    Counts per window and value bucket: time is cut into stretches as long as the reach, so a count is handed to two of them
    at most, not to every window that looks back on it. A stretch is bounded by its windows times the buckets, whatever the
    rows. Values are read again only in the buckets that hold a wanted rank, and only in the stretches that see them.
    """
    steps = reach // every
    stretch = lambda seconds: F.floor(seconds / F.lit(steps * every)).cast("bigint")
    seen = F.explode(F.array_distinct(F.array(stretch(F.col("_at") + every), stretch(F.col("_at") + steps * every)))).alias("_stretch")
    values = values.select(by, "_at", "_v", "_c", value_bucket(F.col("_v")).alias("_b"))
    cells = values.groupBy(by, "_at", "_b").agg(F.sum("_c").alias("_c")).select(by, "_at", "_b", "_c", seen)
    nothing = F.lit(None).cast("bigint")
    asked = windows.select(by, "_at", nothing.alias("_b"), nothing.alias("_c"), stretch(F.col("_at")).alias("_stretch"))
    kind = values.schema[by].dataType.simpleString()
    found = cells.unionByName(asked).groupBy(by, "_stretch").applyInPandas(
        _sliding_ranks(by, every, steps, list(probs.values())), f"{by} {kind}, _start bigint, _b bigint, _before bigint, _n bigint"
    )
    targets = found.withColumn("_stretch", stretch(F.col("_start")))
    near = (
        values.select("*", seen)
        .join(targets, [by, "_stretch", "_b"])
        .where((F.col("_at") <= F.col("_start") - every) & (F.col("_at") >= F.col("_start") - steps * every))
        .groupBy(by, F.col("_start").alias(start), "_b", "_v", "_before", "_n")
        .agg(F.sum("_c").alias("_c"))
    )
    return _picked(near, [by, start], probs)


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    approx: bool = False,
    accuracy: int = 10000,
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> 0..1).

    Ranks between two rows are interpolated linearly. ``approx=True`` keeps a bounded
    sketch per group instead, in a single pass. ``measures`` are additive aggregates
    (sums and counts) of all rows of a group, taken along by the first pass; without
    them a group that has no value has no row.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    if approx:
        found = _approximate(df.where(value.isNotNull()), by, value, probs, accuracy)
        if not measures:
            return found
        return merge_groups(by, df.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()]), found)

    keys = by or ["_all"]
    keyed = df if by else df.withColumn("_all", F.lit(0))
    rows = keyed.where(value.isNotNull()).select(*keys, value.alias("_v"), value_bucket(value).alias("_b"))

    if measures:
        first = cut(
            keyed.withColumn("_b", value_bucket(value))
            .groupBy(*keys, "_b")
            .agg(F.count(value).alias("_c"), *[m.alias(name) for name, m in measures.items()])
        )
        counted = first.where(F.col("_b").isNotNull()).select(*keys, "_b", "_c")
    else:
        counted = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    ends = _holding(counted, keys, probs)
    targets = ends.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_b").alias("_t_b"), "_before", "_n"
    )

    if not by:
        targets = F.broadcast(targets)  # two rows per percentile at most
    else:
        targets = small_side(targets, cheap=bool(measures))  # read off the cut bucket table, if there is one
    match = F.col("_b") == F.col("_t_b")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    near = (
        rows.join(targets, match)
        .groupBy(*keys, "_b", "_v", "_before", "_n")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    out = _picked(near, keys, probs)
    if measures:
        out = merge_groups(keys, first.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in measures]), out)
    return out if by else out.drop("_all")


def merge_groups(by: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Side-by-side columns of several per-group results (groups may be missing in some).

    A union and one aggregation on the group keys: null keys meet each other, and no
    part has to be the driving side of a join.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    values = [c for c in merged.columns if c not in by]
    return merged.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
