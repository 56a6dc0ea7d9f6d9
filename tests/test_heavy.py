"""The most frequent of many keys against full counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import heavy


def first(keys, size):
    return sorted(Counter(k for k in keys if k is not None).items(), key=lambda e: (-e[1], e[0]))[:size]


def rows_of(found):
    return [(r.key, r["count"]) for r in found.collect()]


def keys_of(seed, n=40000):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else f"k{int(rng.paretovariate(0.6)) % 30000}" for _ in range(n)]


@pytest.mark.parametrize("k", [4, 40, 4096])
def test_top_keys_are_exact_whatever_the_counters(spark, k):
    keys = keys_of(1)
    table = spark.createDataFrame([(x,) for x in keys], "key string").repartition(5)
    assert rows_of(heavy.top_keys(table, "key", 15, k)) == first(keys, 15)


def test_counters_stay_below_the_count_and_within_their_error(spark):
    keys, k = keys_of(2), 50
    table = spark.createDataFrame([(x, i * 60) for i, x in enumerate(keys)], "key string, s bigint").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    stored = heavy.summaries(table, "key", "1 day", k).collect()
    error, rows = sum(r.error for r in stored), sum(r.rows for r in stored)
    assert rows == sum(x is not None for x in keys) and error <= rows / (k + 1)
    true, counted = Counter(keys), Counter()
    for r in stored:
        if r.key is not None:
            counted[r.key] += r.counter
    assert all(counted[x] <= n <= counted[x] + error for x, n in true.items() if x is not None)


def test_keys_of_one_size_are_grouped_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(heavy, "MOST", 16)
    keys = [f"k{i % 500:03d}" for i in range(2000)]
    table = spark.createDataFrame([(x,) for x in keys], "key string")
    assert rows_of(heavy.top_keys(table, "key", 7, 4)) == first(keys, 7)
    assert heavy.top_keys(table.limit(0), "key", 7).count() == 0
    assert rows_of(heavy.top_keys(table.limit(3), "key", 7)) == first(keys[:3], 7)
