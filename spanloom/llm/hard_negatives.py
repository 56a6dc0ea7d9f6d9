"""Hard negatives by exact integer scores from a residue number system.

Components are scaled to integers. Anchors and rows are multiplied modulo a few primes below 1024, each product in float32: residues lie
within +-(p - 1) / 2, so a sum over ``WIDE`` components stays below 2**24 and is exact. Chinese remaindering gives the signed score
back. How many primes are needed follows from the longest vector (Cauchy-Schwarz).

Anchors go out in pieces of ``ANCHORS``, each broadcast to tasks that hold one block of rows at a time; rows are not shuffled.
A task keeps, per anchor, the few best so far, so what it sends does not grow with its rows. Positives are
chosen first; a second pass selects negatives inside the window of scores that each positive opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, stored

PRIMES = (1021, 1019, 1013, 1009, 997, 991)
#: Components whose products are summed in float32 at once: WIDE * 510**2 < 2**24.
WIDE = 64
#: Anchors of a piece, and anchors and rows of a tile of scores.
ANCHORS, TILE = 1 << 15, 1 << 10
#: Longest squared length of a vector; all scores are then below half the product of the primes, and 100 times a score is a long.
LONGEST = 1 << 56


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product exceeds all scores within ``+-bound``."""
    product, count = 1, 0
    while product <= 2 * bound:
        product, count = product * PRIMES[count], count + 1
    return PRIMES[: max(1, count)]


class Residues:
    """A matrix of integers modulo each prime, nearest to zero, as float32."""

    def __init__(self, x: np.ndarray, primes: tuple[int, ...]):
        self.parts = [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def scores(a: Residues, b: Residues, primes: tuple[int, ...]) -> np.ndarray:
    """Exact ``a @ b.T`` of the integer matrices behind the residues, given that ``primes`` suffice for it."""
    digits: list[np.ndarray] = []
    out, radix = np.zeros((), np.int64), 1
    for k, (prime, x, y) in enumerate(zip(primes, a.parts, b.parts)):
        rest = np.zeros((len(x), len(y)), np.int32)
        for at in range(0, x.shape[1], WIDE):
            rest = (rest + (x[:, at : at + WIDE] @ y[:, at : at + WIDE].T).astype(np.int32)) % prime
        # Mixed radix: the score is d0 + d1 p0 + d2 p0 p1 + ... modulo all primes; each prime gives the next digit.
        below, step = 0, 1
        for digit, earlier in zip(digits, primes[:k]):
            below = below + digit * (step % prime)
            step *= earlier
        digits.append(((rest - below) % prime * pow(step, -1, prime) % prime if k else rest).astype(np.int32))
        out = out + digits[-1] * np.int64(radix)
        radix *= prime
    return np.where(out > radix // 2, out - radix, out)


def _best(value: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the allowed places of each row the ``count`` highest values, ties by column: rows and columns."""
    lowest = np.iinfo(np.int64).min
    if value.shape[1] > count:
        shown = np.where(allowed, value, lowest)
        least = np.partition(shown, -count, axis=1)[:, -count]
        allowed = allowed & (value >= least[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -value[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < count
    return row[keep], column[keep]


class Kept:
    """The best ``count`` of each slot so far: score and id, ties by smaller id."""

    def __init__(self, count: int):
        self.count = count
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, score, id_ = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left") < self.count
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]


def scaled(value: Column, scale: int) -> Column:
    """Integer components ``floor(scale * x)`` as 64-bit numbers; null unless all are present, finite and not beyond a long."""
    parts = F.transform(value, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    sound = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(float(1 << 28)), F.lit(False)))
    return F.when(value.isNotNull() & sound, parts.try_cast("array<int>"))


def _squares() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def members(vectors: DataFrame, scale: int, label: Column, vec_id: str, embedding: str) -> DataFrame:
    """Rows that take part: ``vec_id``, ``label``, ``v`` (integer components), one row per id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled(F.col(embedding), scale).alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(_squares() <= float(LONGEST)).repartition(spread(vectors.sparkSession), "vec_id")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")


def _matrix(piece: pa.RecordBatch, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their ids: id, label, components (with zeros up to ``wide``), number of components."""
    ids, label = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    v = piece.column("v")
    sizes = np.diff(v.offsets.to_numpy())
    x = np.zeros((len(ids), wide), np.int64)
    x[np.arange(wide)[None, :] < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], label[order], x[order], sizes[order]


class Anchors:
    """One piece of the anchors, as tasks get it, in tiles."""

    def __init__(self, piece: pa.RecordBatch, wide: int, longest: int):
        self.wide, self.primes = wide, primes_for(longest)
        ids, label, x, sizes = _matrix(piece, wide)
        self.tiles = [(ids[k : k + TILE], label[k : k + TILE], x[k : k + TILE].astype(np.int32), sizes[k : k + TILE]) for k in range(0, len(ids), TILE)]
        self.positives: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # per tile: row of the anchor, score, id

    def against(self, batches: Iterator[pa.RecordBatch]):
        """Every tile against every block of rows: number and ids of the tile, ids of the block, scores, rows of equal label, rows to compare."""
        ready = [Residues(x.astype(np.int64), self.primes) for _, _, x, _ in self.tiles]
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                ids, label, x, sizes = _matrix(batch.slice(at, TILE), self.wide)
                rows = Residues(x, self.primes)
                for k, (own, own_label, _, own_sizes) in enumerate(self.tiles):
                    apart = (own_sizes[:, None] == sizes[None, :]) & (own[:, None] != ids[None, :])
                    yield k, own, ids, scores(ready[k], rows, self.primes), own_label[:, None] == label[None, :], apart


def _positives(piece, count: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = piece.value
        kept = [Kept(count) for _ in anchors.tiles]
        for k, _, ids, score, same, apart in anchors.against(batches):
            a, r = _best(score, same & apart, count)
            kept[k].add(a, score[a, r], ids[r])
        for found, (own, *_) in zip(kept, anchors.tiles):
            yield pa.RecordBatch.from_pydict({"anchor_id": own[found.slot], "positive_id": found.id, "positive_score": found.score})

    return work


def _negatives(piece, count: int, low: int, high: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = piece.value
        kept = [Kept(count) for _ in anchors.tiles]
        # The first positives of all anchors are one step, then the second ones, and so on.
        turns = [np.arange(len(owner)) - np.searchsorted(owner, owner, side="left") for owner, _, _ in anchors.positives]
        for k, _, ids, score, same, apart in anchors.against(batches):
            owner, least, _ = anchors.positives[k]
            apart &= ~same
            for turn in range(int(turns[k].max(initial=-1)) + 1):
                slots = np.flatnonzero(turns[k] == turn)
                s, p = score[owner[slots]], least[slots][:, None]
                a, r = _best(s, apart[owner[slots]] & (100 * s >= low * p) & (100 * s <= high * p), count)
                kept[k].add(slots[a], s[a, r], ids[r])
        for found, (own, *_), (owner, least, chosen) in zip(kept, anchors.tiles, anchors.positives):
            yield pa.RecordBatch.from_pydict({
                "anchor_id": own[owner[found.slot]], "positive_id": chosen[found.slot], "positive_score": least[found.slot], "negative_id": found.id, "negative_score": found.score,
            })

    return work


def _top(found: DataFrame, keys: list[str], score: str, id_: str, count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.col(id_))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for every anchor and positive.

    ``is_anchor`` is a condition on ``vec_id`` and ``label``; ``label`` an expression over the columns of ``vectors``. A negative has
    another label and ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    * rows with a null id, label, vector or component, or one that is not finite, take no part; neither do rows with a scaled component
      from 2**28 on or a squared length above 2**56: 100 times their score is no long.
    * of rows that share an id the one with the smallest label and vector takes part.
    * vectors of different length are not compared; an empty vector scores 0. Ties go to the smaller id.
    * an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stored(members(vectors, scale, label, vec_id, embedding), "vectors")
    wide, longest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(_squares()), F.lit(0.0))).first()
    wide, longest = max(1, wide), min(LONGEST, int(longest * (1 + 1e-9)) + 1)
    # Anchors are dealt by a hash into pieces of nearly equal size, at most a quarter above ANCHORS.
    pieces = max(1, -(-rows.where(is_anchor).count() // ANCHORS))
    taken = stored(rows.where(is_anchor).withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "vec_id"), F.lit(pieces))), "anchors")
    first = "anchor_id long, positive_id long, positive_score long"
    every = spark.createDataFrame([], f"{first}, negative_id long, negative_score long")
    for k in range(pieces):
        table = taken.where(F.col("piece") == k).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        anchors = Anchors(table.to_batches()[0], wide, longest)
        found = rows.mapInArrow(_positives(spark.sparkContext.broadcast(anchors), positives), first)
        chosen = _top(found, ["anchor_id"], "positive_score", "positive_id", positives).toPandas().sort_values(["anchor_id", "rank"])
        ids, score, named = (chosen[c].to_numpy(np.int64) for c in ("anchor_id", "positive_score", "positive_id"))
        for own, *_ in anchors.tiles:
            at = (ids >= own[0]) & (ids <= own[-1])
            anchors.positives.append((np.searchsorted(own, ids[at]), score[at], named[at]))
        every = every.unionAll(rows.mapInArrow(_negatives(spark.sparkContext.broadcast(anchors), negatives, low, high), every.schema))
    best = _top(every, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
