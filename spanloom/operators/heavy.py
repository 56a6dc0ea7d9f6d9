"""The most frequent of very many keys, exactly, without grouping all of them.

A first pass keeps a bounded table of counters per task and time bucket: when it holds more than ``k`` keys, the counter of the key
after the k-th is taken off all, and what falls to zero goes. So a counter is never above the true count and below it by what was taken
off, at most rows / (k + 1). Tables of buckets and tasks add up, counters and errors alike, and can be stored. A key that can still
be among the first N by its upper bound is a candidate; a second pass counts the candidates exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side
from .facets import terms

#: Counters of a table at first, and those beyond which all keys are grouped instead.
COUNTERS, MOST = 1 << 12, 1 << 20


def _tables(k: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict = {}
        for frame in frames:
            for bucket, part in frame.groupby("bucket", dropna=False):
                counts, error, rows = tables.get(bucket, (pd.Series(dtype="int64"), 0, 0))
                counts = counts.add(part["key"].value_counts(), fill_value=0).astype("int64")
                if len(counts) > k:
                    off = int(counts.nlargest(k + 1).iloc[-1])
                    counts, error = counts[counts > off] - off, error + off
                tables[bucket] = counts, error, rows + len(part)
        for bucket, (counts, error, rows) in tables.items():
            yield pd.DataFrame({"bucket": bucket, "key": [*counts.index, None], "counter": [*counts, 0], "error": [0] * len(counts) + [error], "rows": [0] * len(counts) + [rows]})

    return work


def summaries(df: DataFrame, column: str, interval: str | None = None, k: int = COUNTERS, ts: str = "ts") -> DataFrame:
    """``bucket, key, counter, error, rows``: counters of at most ``k`` keys per task and bucket, added up over the tasks.

    The row without key has the error of the bucket and its rows. Null keys do not count. Without ``interval`` there is one bucket, null.
    """
    bucket = F.window(ts, interval)["start"].cast("timestamp") if interval else F.lit(None).cast("timestamp")
    rows = df.where(F.col(column).isNotNull()).select(F.unix_micros(bucket).alias("bucket"), F.col(column).cast("string").alias("key"))
    schema = "bucket bigint, key string, counter bigint, error bigint, rows bigint"
    # A bucket of time as a number, -1 for none: pandas has no nullable key.
    tables = rows.withColumn("bucket", F.coalesce("bucket", F.lit(-1))).mapInPandas(_tables(k), schema)
    added = tables.groupBy("bucket", "key").agg(*[F.sum(c).alias(c) for c in ("counter", "error", "rows")])
    return added.withColumn("bucket", F.when(F.col("bucket") >= 0, F.timestamp_micros("bucket")))


def candidates(stored: DataFrame, size: int) -> tuple[DataFrame, bool]:
    """Keys that can be among the first ``size`` over all buckets of ``stored``, and whether no other key can."""
    error = stored.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    lower = stored.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("counter").alias("counter"))
    first = [r["counter"] for r in lower.orderBy(F.desc("counter")).limit(size).select("counter").collect()]
    least = first[-1] if len(first) == size else 0
    return lower.where(F.col("counter") + error >= least).select("key"), error == 0 or least > error


def top_keys(df: DataFrame, column: str, size: int = 10, k: int = COUNTERS) -> DataFrame:
    """The ``size`` most frequent values of ``column`` with their exact ``count``; ties by key.

    If the error leaves a key in doubt that no table holds, more counters are kept; beyond ``MOST`` of them all keys are grouped.
    """
    while k <= MOST:
        chosen, certain = candidates(cut(summaries(df, column, k=k)), size)
        if certain:
            return verified(df, column, chosen, size)
        k *= 8
    return terms(df, column, size)


def verified(df: DataFrame, column: str, chosen: DataFrame, size: int) -> DataFrame:
    """The first ``size`` of the chosen keys by their exact counts."""
    keys = small_side(chosen.select(F.col("key").alias("_chosen")))
    mine = df.join(keys, F.col(column).cast("string") == F.col("_chosen"), "left_semi")
    return terms(mine, column, size)
