"""Benchmark decontamination: which words of a document lie in a passage of a benchmark.

Wu-Manber search over words. Words become small numbers (0: not in the benchmark), windows of the benchmark
become patterns. For patterns of one length, a shift table over blocks of two words says how far a search
may advance without missing a pattern; where it says 0, a hash of the last block (the suffix) names the few
patterns to compare word by word. All texts of a batch are searched together: each chunk of positions is one
lane, and numpy advances all lanes at once.

One map over the documents, no shuffle. The benchmark is broadcast in pieces of at most ``piece_bytes`` of
text; several pieces are several passes, each written to the shared folder, so memory stays bounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, free_name, settle, stored, with_columns

WINDOW = 10
PIECE_BYTES = 16 << 20
LANE = 256
#: Every byte that is no word byte becomes a blank, A-Z become a-z.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def fold(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased."""
    return as_bytes(text).translate(FOLD).split()


class Patterns:
    """All windows of a set of benchmark items, with one Wu-Manber table for each pattern length."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            found = fold(text)
            for i in range(max(1, len(found) - window + 1) if found else 0):
                owners[tuple(found[i : i + window])].add(item)
        self.ids = {w: n + 1 for n, w in enumerate(sorted({w for p in owners for w in p}))}
        self.owners = [sorted(owners[p]) for p in sorted(owners)]
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        numbers: dict[int, list[int]] = defaultdict(list)
        for n, p in enumerate(sorted(owners)):
            by_length[len(p)].append(tuple(self.ids[w] for w in p))
            numbers[len(p)].append(n)
        self.tables = [Table(np.array(by_length[m], np.int64), np.array(numbers[m])) for m in sorted(by_length)]

    def symbols(self, found: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))


class Table:
    """Shift table and suffix buckets of patterns that all have ``m`` words."""

    BITS = 18

    def __init__(self, patterns: np.ndarray, numbers: np.ndarray):
        self.m = patterns.shape[1]
        self.block = min(2, self.m)
        self.shift = np.full(1 << self.BITS, self.m - self.block + 1, np.int64)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._hash(patterns, end), self.m - 1 - end)
        suffix = self._hash(patterns, self.m - 1)
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.numbers = patterns[order], numbers[order]
        self.starts = np.searchsorted(suffix[order], np.arange((1 << self.BITS) + 1))

    def _hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self._mix(rows[:, end], rows[:, end - 1] if self.block == 2 else 0)

    def _mix(self, last, before):
        h = (last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.asarray(before).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of occurrences in the joined ``text`` and the numbers of their patterns.

        ``first[i]`` is where the document of position ``i`` begins.
        """
        n, m = len(text), self.m
        lanes = np.arange(0, n, LANE)
        at, stop = lanes.copy(), np.minimum(lanes + LANE, n)
        ends, found = [], []
        while len(at):
            before = text[np.maximum(at - 1, 0)] if self.block == 2 else 0
            h = self._mix(text[at], before)
            step = self.shift[h]
            hit = np.flatnonzero((step == 0) & (at - first[at] >= m - 1))
            if len(hit):
                counts = self.starts[h[hit] + 1] - self.starts[h[hit]]
                where = np.repeat(at[hit], counts)
                offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                candidate = np.repeat(self.starts[h[hit]], counts) + offset
                same = np.ones(len(where), bool)
                for k in range(m):
                    live = np.flatnonzero(same)
                    same[live] = text[where[live] - k] == self.patterns[candidate[live], m - 1 - k]
                ends.append(where[same])
                found.append(self.numbers[candidate[same]])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spans_in(texts: list[str | None], patterns: Patterns) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, hit word ranges [from, to) and the items found."""
    split = [patterns.symbols(fold(t)) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.concatenate([*split, np.zeros(0, np.int64)])
    first = np.repeat(starts, sizes)
    ranges: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for table in patterns.tables:
        ends, found = table.search(text, first)
        for e, p in zip(ends.tolist(), found.tolist()):
            d = int(np.searchsorted(starts, e, side="right")) - 1
            ranges[d].append((e - table.m + 1 - int(starts[d]), e + 1 - int(starts[d])))
            items[d].update(patterns.owners[p])
    for d, size in enumerate(sizes.tolist()):
        yield size, merged(ranges.get(d, [])), sorted(items.get(d, ()))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges as ``from:to``) and ``hit_items`` added.

    * null, empty or wordless document: 0 words, no spans; null columns elsewhere pass through.
    * null or wordless benchmark text: no pattern; rows without item id are left out.
    * repeated items or texts: one pattern, all item ids that own it; repeated documents: a row each.
    * an empty benchmark hits nothing, empty documents give an empty result.
    * columns of ``docs`` that have one of the new names keep theirs; the new ones then get underscores.
    """
    spark = docs.sparkSession
    taken = docs.columns
    names = [free_name(n, taken) for n in ("n_words", "hit_spans", "hit_items")]
    source = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL")
    volume = source.select(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    pieces = max(1, -(-int(volume) // piece_bytes))
    out = docs.select(
        "*",
        F.lit(None).cast("long").alias(names[0]),
        F.array().cast("array<array<long>>").alias(names[1]),
        F.array().cast("array<string>").alias(names[2]),
    )
    for k in range(pieces):
        rows = source.where(F.pmod(F.xxhash64("item", "text"), F.lit(pieces)) == k).toLocalIterator()
        shared = spark.sparkContext.broadcast(Patterns(((r["item"], r["text"]) for r in rows), window))
        out = out.mapInArrow(_worker(shared, text, names), out.schema)
        if pieces > 1:
            out = stored(out, "decontaminate")
            shared.unpersist()
    return out


def _worker(shared, text: str, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        patterns = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                sizes, ranges, items = [], [], []
                old = zip(batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist())
                for (n, r, i), (old_r, old_i) in zip(spans_in(batch.column(text).to_pylist(), patterns), old):
                    sizes.append(n)
                    ranges.append(merged([*map(tuple, old_r), *r]))
                    items.append(sorted({*old_i, *i}))
                yield with_columns(batch, {names[0]: sizes, names[1]: ranges, names[2]: items})

    return work


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts, digest of the sorted item ids, and whether any word is hit."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
