"""Mixing sources to target weights by balanced sampling (cube method).

Every source gets a target number of words. A source's rate, target over size, is met by ``floor(rate)`` copies
of every document and one more of a sample whose inclusion probability is the rest. The sample is balanced
on two totals, words and documents: the flight phase takes three undecided documents at a time and moves their
probabilities along the null space of both totals until one of them is 0 or 1, so neither total changes.

Flights run side by side over chunks of about ``UNITS`` documents of one source (chosen by hash, so a source
with a third of all rows is many chunks), each leaving at most two undecided documents. Those of all chunks
of a source fly again, until one chunk per source is left. A chunk keeps up to ``POOL`` documents undecided and
flies the two longest with the shortest, so short ones remain; those of the last chunk are the landing, rounded to what comes
closest to both totals. Chances come from hashes of the rows: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, settle, spread, stored

UNITS = 1000
POOL = 14
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
#: A table of sources up to this size goes to every task; a larger one is joined by a shuffle.
SMALL_BYTES = 16 << 20
NEAR = 1e-9


def n_words(text: str):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a column (null: 0)."""
    split = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(split, lambda w: w != "")).cast("long")


def shares(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Targets in proportion to ``weights`` that sum to all sizes, none above ``most`` times its size."""
    cap, total = sizes * most, sizes.sum()
    if not total:
        return np.zeros(len(sizes))
    order = np.argsort(cap / weights, kind="stable")
    filled = np.concatenate([[0.0], np.cumsum(cap[order])[:-1]])
    left = np.cumsum(weights[order][::-1])[::-1]
    level = (total - filled) / left
    k = int(np.argmax(level <= cap[order] / weights[order] * (1 + 1e-15)))
    return np.minimum(cap, level[k] * weights)


def targets(sized: DataFrame, source: str, size: str, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: its size, documents and target. Weights repeat over sources by code point, null last."""
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([*frames, pd.DataFrame({"source": [], "source_size": [], "n_docs": []})])
        key = [(s is None, b"" if s is None else s.encode("utf-8", "surrogatepass")) for s in frame["source"]]
        frame = frame.iloc[sorted(range(len(frame)), key=key.__getitem__)]
        sizes = frame["source_size"].to_numpy(np.float64)
        given = np.array([weights[i % len(weights)] for i in range(len(frame))])
        yield frame.assign(target=shares(sizes, given, most)).astype({"source_size": "int64", "n_docs": "int64"})

    return totals.coalesce(1).mapInPandas(work, "source string, source_size long, n_docs long, target double")


def mix(docs: DataFrame, text: str | None = "text", source: str = "source", size: str | None = None, doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, units: int = UNITS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies).

    * null and empty texts have size 0; they are balanced as documents and take 0 words.
    * a null source is a source of its own and comes last; a source without words has target 0.
    * repeated rows are documents of their own; equal documents are told apart by chance only.
    * an empty table gives an empty result; columns with clashing names keep theirs (the new ones get underscores).
    ``size`` names a column that already holds the size; ``text`` is then not read.
    """
    spark = docs.sparkSession
    taken = docs.columns
    name = {n: free_name(n, taken) for n in ("size", "source_size", "target", "copies", "taken")}
    own = {n: free_name(f"mix_{n}", taken) for n in ("source", "units", "chunk", "order", "p")}
    rows = docs.withColumn(name["size"], n_words(text) if size is None else F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")))
    goal = stored(targets(rows, source, name["size"], weights, most), "targets")
    goal_bytes = goal.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    goal = goal.select(F.col("source").alias(own["source"]), F.col("source_size").alias(name["source_size"]), F.col("n_docs").alias(own["units"]), F.col("target").alias(name["target"]))
    if goal_bytes <= SMALL_BYTES:
        goal = F.broadcast(goal)
    rate = F.when(F.col(name["source_size"]) > 0, F.col(name["target"]) / F.col(name["source_size"])).otherwise(F.lit(0.0))
    rows = rows.join(goal, F.col(source).eqNullSafe(F.col(own["source"])))
    rows = rows.withColumn(name["copies"], F.floor(rate + F.lit(NEAR)))
    rows = rows.withColumn(own["p"], F.greatest(rate - F.col(name["copies"]), F.lit(0.0)))
    rows = rows.withColumn(own["order"], F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(name["size"])))

    decided: list[DataFrame] = []
    while True:
        chunks = F.ceil(F.col(own["units"]) / units)
        one = rows.agg(F.max(own["units"])).first()[0] if decided else goal.agg(F.max(own["units"])).first()[0]
        last = (one or 0) <= units
        chunked = rows.withColumn(own["chunk"], F.pmod(F.xxhash64(own["order"]), F.greatest(chunks, F.lit(1))))
        keys = [own["source"], own["chunk"]]
        ordered = chunked.repartition(spread(spark), *keys).sortWithinPartitions(*keys, own["order"])
        flown = ordered.mapInArrow(_flight(name, own, last), ordered.schema)
        if last and not decided:
            decided = [flown]
            break
        flown = flown if last else stored(flown, "flight")
        decided.append(flown if last else flown.where(F.col(own["p"]) <= 0))
        if last:
            break
        rows = flown.where(F.col(own["p"]) > 0).drop(own["chunk"])
        counts = F.broadcast(rows.groupBy(F.col(own["source"]).alias("s")).agg(F.count(F.lit(1)).alias("n"))) if goal_bytes <= SMALL_BYTES else rows.groupBy(F.col(own["source"]).alias("s")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(counts, F.col(own["source"]).eqNullSafe(F.col("s"))).withColumn(own["units"], F.col("n")).drop("s", "n")
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    out = out.withColumn(name["taken"], F.col(name["size"]) * F.col(name["copies"]))
    return out.select(*taken, *(name[n] for n in ("size", "source_size", "target", "copies", "taken")))


def chance(seed: int) -> float:
    """A number in [0, 1) from a 64-bit hash."""
    z = (seed + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def move(p: list[float], x: list[float], u: float) -> list[float]:
    """One step of the flight of three units: along the null space of (x, 1) until one of them is decided."""
    way = [x[1] - x[2], x[2] - x[0], x[0] - x[1]]
    if not any(way):
        way = [1.0, -1.0, 0.0]
    up = min((1 - a) / v if v > 0 else a / -v for a, v in zip(p, way) if v)
    down = min(a / v if v > 0 else (1 - a) / -v for a, v in zip(p, way) if v)
    step = up if u < down / (up + down) else -down
    moved = [a + step * v for a, v in zip(p, way)]
    nearest = min(range(3), key=lambda i: min(moved[i], 1 - moved[i]) if way[i] else 2)
    moved[nearest] = round(moved[nearest])  # the one that the step was cut for
    return [0.0 if a < NEAR else 1.0 if a > 1 - NEAR else a for a in moved]


def land(p: list[float], x: list[float]) -> list[int]:
    """Rounds the last undecided units: of all ways, the closest in words and documents together."""
    ways = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    away = ways - np.array(p)
    mean = max(1.0, sum(x) / len(x))
    return ways[int(np.argmin(np.abs(away @ np.array(x)) / mean + 0.1 * np.abs(away.sum(axis=1))))].tolist()


def _flight(name: dict, own: dict, last: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: pa.Table | None = None  # rows still undecided, at most POOL
        group = None
        for batch in _with_end(batches):
            if batch is None:
                table, end = held, True
            else:
                table, end = pa.Table.from_batches([batch]), False
                if held is not None:
                    table = pa.concat_tables([held, table])
            if table is None or not table.num_rows:
                continue
            p = table.column(own["p"]).to_pylist()
            x = table.column(name["size"]).to_pylist()
            seeds = table.column(own["order"]).to_pylist()
            keys = list(zip(table.column(own["source"]).to_pylist(), table.column(own["chunk"]).to_pylist()))
            extra = [0] * len(p)
            pool: list[int] = []
            done = [True] * len(p)

            def fly(i: int) -> None:
                by_size = sorted(pool, key=lambda j: (-x[j], j))
                three = [*by_size[:2], by_size[-1]]  # so the probabilities of the two longest move most
                moved = move([p[j] for j in three], [float(x[j]) for j in three], chance(seeds[i] + len(pool)))
                for j, a in zip(three, moved):
                    p[j] = a
                    if a in (0.0, 1.0):
                        extra[j], p[j] = int(a), 0.0
                        pool.remove(j)

            def leave() -> None:
                while not last and len(pool) > 2:
                    fly(pool[-1])
                if last and pool:
                    for i, s in zip(pool, land([p[i] for i in pool], [float(x[i]) for i in pool])):
                        extra[i], p[i] = s, 0.0
                pool.clear()

            for i, key in enumerate(keys):
                if key != group:
                    leave()
                    group = key
                if p[i] <= NEAR or p[i] >= 1 - NEAR:
                    extra[i], p[i] = round(p[i]), 0.0
                    continue
                pool.append(i)
                if len(pool) > POOL:
                    fly(i)
            if end:
                leave()
            for i in pool:
                done[i] = False
            copies = [c + e for c, e in zip(table.column(name["copies"]).to_pylist(), extra)]
            # the field with its nullability: what is held must have the schema of the next batch
            put = lambda t, n, v: t.set_column(t.schema.get_field_index(n), t.schema.field(n), pa.array(v, t.schema.field(n).type))
            table = put(put(table, name["copies"], copies), own["p"], p)
            held = table.filter(pa.array([not d for d in done]))
            yield from table.filter(pa.array(done)).combine_chunks().to_batches()

    return work


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def report(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
