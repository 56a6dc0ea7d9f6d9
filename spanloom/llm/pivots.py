"""Embedding near-duplicates by a pivot-permutation index.

``PIVOTS`` reference points are chosen from a bounded sample, none closer to another than ``APART``. A vector is
described by the ordered list of its ``NEAREST`` pivots. Vectors that share at least ``SHARED`` of them meet in
the inverted list of those pivots: lists are kept per set of ``SHARED`` pivots, so that meeting in one is
having the count. Members of a list are compared exactly, in double precision; a pair that meets in several
lists counts in the first of them only.

Equal vectors are one vertex with a weight. A list above ``BLOCK`` vectors is cut into blocks and worked on as
pairs of blocks. Lists send no pairs: only link counts per vertex and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, spread, stored
from .graph import components

SAMPLE, PIVOTS, APART = 2048, 256, 0.8
NEAREST, SHARED = 5, 2
BLOCK = 1024


def unit(values) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it has no direction."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def choose(sample: list[np.ndarray], count: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Of a sample in fixed order, vectors that are not near one taken before (all as long as the longest)."""
    width = max(map(len, sample), default=1)
    chosen = np.zeros((0, width))
    for x in sample:
        x = np.pad(x, (0, width - len(x)))
        if len(chosen) < count and (not len(chosen) or (chosen @ x).max() < apart):
            chosen = np.vstack([chosen, x])
    return chosen


def nearest(x: np.ndarray, pivots: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    width = pivots.shape[1]
    x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :count]


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row number connected with each of ``n`` rows."""
    out = np.arange(n)
    while len(i):
        a, b = out[i], out[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(out, np.maximum(a, b), np.minimum(a, b))
        while (out[out] != out).any():
            out = out[out]
    return out


def _lists(least: float, shared: int):
    def work(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = [int(p) for p in str(group["list"].iloc[0]).split(",")[1:]]
        ids, weight, own = group["vertex"].to_numpy(), group["weight"].to_numpy(), group["own"].to_numpy()
        i_block, j_block = group["i"].iloc[0], group["j"].iloc[0]
        x = np.stack([np.frombuffer(v, np.float64) for v in group["x"]])
        near = np.sort(np.stack([np.frombuffer(p, np.int32) for p in group["near"]]), axis=1)
        left, right = np.flatnonzero(own == i_block), np.flatnonzero(own == j_block)
        if i_block == j_block:
            a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        else:
            a, b = np.nonzero(x[left] @ x[right].T >= least)
            a, b = left[a], right[b]
        count = np.zeros(len(ids), np.int64)
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 16):
            u, v = near[a[k : k + (1 << 16)]], near[b[k : k + (1 << 16)]]
            common = (u[:, :, None] == v[:, None, :]).any(axis=2)
            first = np.argsort(~common, axis=1, kind="stable")[:, :shared]
            keep[k : k + (1 << 16)] = (np.take_along_axis(u, first, axis=1) == np.array(key)).all(axis=1)
        a, b = a[keep], b[keep]
        np.add.at(count, a, weight[b])
        np.add.at(count, b, weight[a])
        root = labels(len(ids), a, b)
        linked = np.flatnonzero(count)
        yield pd.DataFrame({"vertex": ids[linked], "links": count[linked], "root": ids[root[linked]]})

    return lambda frames: runs(frames, ["list", "i", "j"], work)


def near_duplicates(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    * vectors that are null, empty, zero, or hold a null or non-finite component link with nothing.
    * equal vectors and repeated rows link with each other; vectors of different length are never compared.
    * an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [unit(v) for v in batch.column("v").to_pylist()]
            raw = [None if u is None else u.tobytes() for u in x]
            vertex = [None if r is None else xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vertex, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "vertex", "x"])

    members = stored(source.mapInArrow(describe, "vec_id long, vertex long, x binary"), "vectors")
    valid = members.where("vertex IS NOT NULL")
    reps = stored(valid.groupBy("vertex").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.first("x").alias("x")), "vertices")
    drawn = reps.orderBy(F.xxhash64(F.lit("pivot"), "vertex"), "vertex").limit(SAMPLE).select("x").collect()
    pivots = spark.sparkContext.broadcast(choose([np.frombuffer(bytes(r["x"]), np.float64) for r in drawn]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value
        for batch in batches:
            near = [nearest(np.frombuffer(x, np.float64)[None, :], points)[0].astype(np.int32) for x in batch.column("x").to_pylist()]
            keys = [[f"{len(x) // 8}," + ",".join(map(str, c)) for c in combinations(sorted(n.tolist()), min(SHARED, len(n)))] for n, x in zip(near, batch.column("x").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n.tobytes() for n in near], pa.binary()), pa.array(keys, pa.list_(pa.string()))], names=[*batch.schema.names, "near", "lists"])

    described = reps.select("vertex", "weight", "x").mapInArrow(post, "vertex long, weight long, x binary, near binary, lists array<string>")
    described = stored(described, "described")
    posted = described.select("vertex", F.explode("lists").alias("list"))
    blocks = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("size")).where("size > 1").select("list", "blocks")
    full = described.select("vertex", "weight", "x", "near", F.explode("lists").alias("list")).join(blocks, "list")
    full = full.withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    full = full.select("list", "vertex", "weight", "x", "near", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    keys = ["list", "i", "j"]
    shared = min(SHARED, max(1, len(pivots.value)))
    found = full.repartition(spread(spark), *keys).sortWithinPartitions(*keys, "vertex").mapInPandas(_lists(least, shared), "vertex long, links long, root long")
    found = stored(found, "links")
    links = found.groupBy("vertex").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("vertex").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("vertex"), "component")
    named = reps.select("vertex", "weight", "first").join(links, "vertex", "left").join(joined, "vertex", "left")
    named = named.withColumn("component", F.coalesce("component", "vertex")).withColumn("links", F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("vertex", F.col("links").alias("n_links"), "component_id")
    out = valid.select("vec_id", "vertex").join(named, "vertex").select("vec_id", "n_links", "component_id")
    alone = members.where("vertex IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
