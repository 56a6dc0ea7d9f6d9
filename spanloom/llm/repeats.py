"""Repeated passages: bytes covered by a string of ``length`` bytes that also starts elsewhere.

A difference-cover suffix array finds them, over the text that can hold one. Which that is, winnowing tells: of
the hashes of all ``GRAM``-byte strings in a window of ``length`` bytes the least marks an anchor; equal windows have
equal anchors in equal places. So a repeated window lies in the contexts (``length`` bytes and the anchor's reach
before) of two anchors of one hash, and an anchor whose hash occurs once needs no look. Contexts that occur
twice as a whole are repeated all over and need none either; of the others, only those that have half a window
around the anchor in common with another can hold a repeated one. What is left (contexts at the edges of repeated
passages) is cut to the bytes around the anchor that another context has too, and sorted: suffixes at sampled
positions by their triples, by recursion on the names of the triples, merged with the others, and neighbours in
that order compared over ``length`` bytes.

Work is dealt by anchor hash; counts of contexts are combined before they are shuffled, so a passage in a third of
all documents is one row per task. A hash with more than ``MOST`` contexts that differ is dealt on by windows: chunks
of contexts send each window once to a bucket of windows, which answers a bit for it.
The texts are read twice from the source. They are shuffled once, into a table bucketed by their key, where the
contexts are cut out and the spans removed at every size of the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import as_bytes, parts_for, runs, settle, spread, stored

LENGTH, GRAM = 200, 40
PIECE = 1 << 20
#: Anchors that a task holds before it sends their counts, and contexts that are known to every task.
FLUSH, KNOWN = 2 << 20, 4 << 20
#: Contexts of one anchor that are sorted in one task, and bytes of contexts that are cut and sorted together.
MOST, TOGETHER = 5000, 1 << 16
#: Contexts whose windows are sent together, and contexts whose windows are hashed at once.
CHUNK, BLOCK = 8192, 512
#: The place of a window that a chunk holds at two places.
TWICE = -(1 << 63)


# --- anchors ---

_MIXED = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on (as many positions as there are whole strings)."""
    n = len(text) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = {1: _MIXED[text]}
    factor = {1: 0x9E3779B97F4A7C15}
    k = 1
    while 2 * k <= size:
        h = powers[k]
        powers[2 * k] = h[:-k] * np.uint64(factor[k]) + h[k:]
        factor[2 * k] = factor[k] * factor[k] % (1 << 64)
        k *= 2
    out, at = np.zeros(n, np.uint64), 0
    while at < size:
        k = 1 << ((size - at).bit_length() - 1)
        out = out * np.uint64(factor[k]) + powers[k][at : at + n]
        at += k
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``width`` values from each position on."""
    k, out = 1, values
    while 2 * k <= width:
        out = pick(out[:-k], out[k:])
        k *= 2
    rest = width - k
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all strings that are the least of some window of a text."""
    width = length - gram + 1
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(text, gram)
    least = sliding(hashes, width, np.minimum)  # of the windows that begin at each position
    edge = np.zeros(width - 1, np.uint64)
    greatest = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(greatest == hashes)
    return at, hashes[at]


def found_anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a text of any length, in pieces that overlap so that every window lies in one."""
    at, hashes = [], []
    for begin in range(0, max(1, len(raw) - length + 1), PIECE):
        a, h = anchors(np.frombuffer(raw, np.uint8)[begin : begin + PIECE + length], length, gram)
        at.append(a + begin)
        hashes.append(h)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(hashes)[first]


# --- suffix arrays ---


def packed(*columns: np.ndarray) -> np.ndarray | None:
    """Columns side by side in one number each; None if that takes more than 63 bits."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        return None
    out = columns[0].astype(np.int64)
    for c, b in zip(columns[1:], bits[1:]):
        out <<= b
        out |= c
    return out


def ranked(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their columns, and the rank of each row (equal rows share one, from 1 on)."""
    n = len(columns[0])
    one = packed(*columns)
    bits = n.bit_length()
    change = np.zeros(n, np.int64)
    if one is not None and n and int(one.max()).bit_length() + bits <= 63:  # places side by side with the columns
        both = np.sort((one << bits) | np.arange(n))
        order = both & ((1 << bits) - 1)
        both >>= bits
        change[1:] = both[1:] != both[:-1]
    else:
        order = np.lexsort(columns[::-1]) if one is None else np.argsort(one)
        for c in columns if one is None else (one,):
            change[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(change) + 1
    return order, rank


def before(sorted_columns: tuple[np.ndarray, ...], columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each row, how many of the sorted rows come before it (none is equal)."""
    n = len(sorted_columns[0])
    both = packed(*(np.concatenate(pair) for pair in zip(sorted_columns, columns)))
    if both is None:
        order = np.lexsort([np.concatenate(pair) for pair in zip(sorted_columns, columns)][::-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank[n:] - np.argsort(np.argsort(rank[n:]))
    return np.searchsorted(both[:n], both[n:])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (values from 1 on) in order, by the difference cover {1, 2} modulo 3.

    Triples at sampled positions are sorted and named; if names repeat, the sequence of names is sorted by
    recursion. The other suffixes follow from their first value and the rank of the sampled one behind. They are
    merged by counting, for each, the sampled ones before it: those at 1 modulo 3 by a value and a rank, those
    at 2 by two values and a rank.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(3, s.dtype)])
    past = n + (n % 3 == 1)  # one position past the end keeps names apart
    sample = np.concatenate([np.arange(1, past, 3), np.arange(2, n, 3)])
    order, names = ranked(*(np.concatenate([padded[1 + k : past + k : 3], padded[2 + k : n + k : 3]]) for k in range(3)))
    if names.max(initial=0) < len(names):
        order = suffix_array(names)
        names = np.empty(len(names), np.int64)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    rank[n:] = 0
    sampled = sample[order]
    sampled = sampled[sampled < n]
    others = 3 * ranked(padded[:n:3], rank[1 : n + 1 : 3])[0]
    first = sampled % 3 == 1
    one, two = sampled[first], sampled[~first]
    place = np.arange(len(others))
    place += before((padded[one], rank[one + 1]), (padded[others], rank[others + 1]))
    place += before((padded[two], padded[two + 1], rank[two + 2]), (padded[others], padded[others + 1], rank[others + 2]))
    out = np.empty(n, np.int64)
    out[place] = others
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sampled
    return out


def repeated_starts(contexts: list[bytes], places: list[int], length: int) -> list[np.ndarray]:
    """Per context, the positions where ``length`` bytes start that also start elsewhere.

    ``places`` tells where a context begins: two contexts of one document may overlap, and a string is not
    its own repetition.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(int((sizes + 1).sum()), bool)
    inside[begins + sizes] = False
    text = np.ones(len(inside), np.int64)  # 1 ends a context
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 2
    order = suffix_array(text)
    offset = np.arange(len(text)) - np.repeat(begins, sizes + 1)
    order = order[(np.repeat(sizes, sizes + 1) - offset)[order] >= length]
    place = (np.repeat(np.array(places, np.int64), sizes + 1) + offset)[order]
    # A suffix that counts has ``length`` bytes in its context, so neighbours are compared by words of eight.
    wide = 8 if length >= 8 else 1
    octets = np.append((text - 2).astype(np.uint8), np.zeros(wide - 1, np.uint8))
    word = np.ndarray((len(text),), f"<u{wide}", buffer=octets, strides=(1,)).copy()
    live = np.arange(max(0, len(order) - 1))
    for k in [*range(0, length - wide + 1, wide), length - wide]:
        live = live[word[order[live] + k] == word[order[live + 1] + k]]
    first = np.ones(len(order), bool)
    first[live + 1] = False
    runs_at = np.flatnonzero(first)
    starts = np.zeros(len(text), bool)
    if len(runs_at):
        apart = np.minimum.reduceat(place, runs_at) != np.maximum.reduceat(place, runs_at)
        starts[order[apart[np.cumsum(first) - 1]]] = True
    return [np.flatnonzero(starts[p : p + n]) for p, n in zip(begins.tolist(), sizes.tolist())]


# --- jobs ---


def _bodies(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Id, text and key of every row; rows of equal id and text have one key, and the same spans."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    return body.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(-1 << 63)), "body"))


def _marked(source: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per anchor: its hash and place, and hash, begin and end of its context (the hash tells where in it the anchor is).

    ``left`` and ``right`` are hashes of the anchor's string with half a window before it, or behind it (0 where
    the text is too short); every window around the anchor holds one of the two.
    """
    reach, half = length - gram, (length - gram) // 2
    digest = xxhash.xxh3_64_intdigest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                keys, hashes, places, begins, ends, contexts, lefts, rights = [], [], [], [], [], [], [], []
                for key, body in zip(piece.column("key").to_pylist(), piece.column("body").to_pylist()):
                    raw = as_bytes(body)
                    at, found = found_anchors(raw, length, gram)
                    begin, end = np.maximum(at - reach, 0), np.minimum(at + length, len(raw))
                    contexts += [xxhash.xxh3_64_intdigest(raw[i:j], seed=p) - (1 << 63) for i, j, p in zip(begin.tolist(), end.tolist(), (at - begin).tolist())]
                    lefts += [digest(raw[p - half : p + gram]) - (1 << 63) if p >= half else 0 for p in at.tolist()]
                    rights += [digest(raw[p : p + gram + half], seed=1) - (1 << 63) if p + gram + half <= len(raw) else 0 for p in at.tolist()]
                    keys.append(np.full(len(at), key))
                    hashes.append(found)
                    places.append(at)
                    begins.append(begin)
                    ends.append(end)
                anchor = (np.concatenate(hashes) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(anchor), pa.array(contexts, pa.int64()), pa.array(np.concatenate(places)), pa.array(np.concatenate(begins)), pa.array(np.concatenate(ends)), pa.array(lefts, pa.int64()), pa.array(rights, pa.int64())],
                    names=["key", "anchor", "context", "at", "begin", "end", "left", "right"],
                )

    return source.select("key", "body").mapInArrow(work, "key long, anchor long, context long, at long, begin long, end long, left long, right long")


def combined(anchor: np.ndarray, context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with their counts."""
    order = np.lexsort((context, anchor))
    anchor, context, count = anchor[order], context[order], count[order]
    first = np.ones(len(order), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
    at = np.flatnonzero(first)
    return anchor[at], context[at], np.add.reduceat(count, at) if len(at) else count


def _known(marked: DataFrame, buckets: int) -> DataFrame:
    """Contexts of anchors that occur more than once: how many contexts the anchor has, and whether this one repeats.

    Tasks count what they read before it is dealt by anchor.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, c, n = combined(*(np.concatenate(x) for x in zip(*held)))
            to = a % buckets
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[k] : cuts[k + 1]]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "payload": [a[some].tobytes() + c[some].tobytes() + n[some].tobytes()]})

        for batch in batches:
            if batch.num_rows:
                a, c = (batch.column(x).to_numpy() for x in ("anchor", "context"))
                held.append((a, c, np.ones(len(a), np.int64)))
                total += len(a)
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    def merge(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(p, np.int64).reshape(3, -1) for p in group["payload"]]
        a, c, n = combined(*np.concatenate(parts, axis=1))
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        contexts, every = np.diff(np.append(first, len(a))), np.add.reduceat(n, first)
        owner = np.repeat(np.arange(len(first)), contexts)
        keep = every[owner] > 1
        yield pd.DataFrame({"context": c[keep], "contexts": contexts[owner][keep], "repeated": n[keep] > 1})

    dealt = marked.select("anchor", "context").mapInArrow(local, "bucket long, payload binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(lambda frames: runs(frames, ["bucket"], merge), "context long, contexts long, repeated boolean")


def _seen(marked: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """Of the marked rows: ranges of contexts that repeat as a whole, and contexts that differ from others of their anchor.

    A known table of at most ``KNOWN`` rows (12 bytes each) goes to every task, else both sides are joined.
    """
    spark = marked.sparkSession
    if known.count() > KNOWN:
        both = marked.join(known, "context")
        whole = both.where(F.col("repeated") & (F.col("end") - F.col("begin") >= length)).select("key", "begin", "end")
        differ = both.where("contexts > 1").select("key", "begin", "end", "at", "anchor", "context", "contexts", "repeated", "left", "right")
        return whole.unionByName(differ, allowMissingColumns=True)
    found, signed = _gathered(known.select("context", F.when(F.col("repeated"), -F.col("contexts")).otherwise(F.col("contexts"))))
    shared = spark.sparkContext.broadcast((found, np.clip(signed, -(1 << 30), 1 << 30).astype(np.int32)))
    names = ["key", "begin", "end", "at", "anchor", "context", "contexts", "repeated", "left", "right"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, facts = shared.value
        for batch in batches:
            if not batch.num_rows or not len(contexts):
                continue
            key, anchor, context, place, begin, end, left, right = (c.to_numpy() for c in batch.columns)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            hit = contexts[at] == context
            many, repeated = np.abs(facts[at]).astype(np.int64), facts[at] < 0
            rows = np.flatnonzero(hit & repeated & (end - begin >= length))
            if len(rows):  # anchors come in order, so ranges that touch are neighbours
                k, b, e = key[rows], begin[rows], end[rows]
                first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (b[1:] > e[:-1])))
                last = np.append(first[1:], len(rows)) - 1
                none = pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(b[first]), pa.array(e[last]), none, none, none, none, pa.nulls(len(first), pa.bool_()), none, none], names=names)
            rows = np.flatnonzero(hit & (many > 1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (key, begin, end, place, anchor, context, many, repeated, left, right)], names=names)

    return marked.select("key", "anchor", "context", "at", "begin", "end", "left", "right").mapInArrow(
        work, "key long, begin long, end long, at long, anchor long, context long, contexts long, repeated boolean, left long, right long"
    )


def _gathered(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two long columns of a table of bounded size, sorted by the first."""
    names = pairs.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"payload": [b"".join(c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in batch.columns)]})

    parts = [np.frombuffer(bytes(r["payload"]), np.int64).reshape(len(names), -1) for r in pairs.mapInArrow(pack, "payload binary").toLocalIterator()]
    first, second = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
    order = np.argsort(first)
    return first[order], second[order]


def _likely(differ: DataFrame, buckets: int) -> DataFrame:
    """Of contexts that differ, those with a half that another one has too; the others hold no repeated window."""
    halves = differ.select(F.explode(F.array("left", "right")).alias("anchor")).where("anchor <> 0").withColumn("context", F.col("anchor"))
    twice = stored(_known(halves, buckets).where("repeated").select(F.col("context").alias("half")), "halves")
    if twice.count() > KNOWN:
        ways = [differ.join(twice, F.col(side) == F.col("half"), "left_semi") for side in ("left", "right")]
        return ways[0].unionByName(ways[1]).dropDuplicates(["key", "at", "anchor", "context"])
    shared = differ.sparkSession.sparkContext.broadcast(_gathered(twice.select("half", F.lit(0).cast("long").alias("n")))[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            if batch.num_rows and len(found):
                hit = np.zeros(batch.num_rows, bool)
                for side in ("left", "right"):
                    values = batch.column(side).to_numpy()
                    hit |= found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values
                yield batch.filter(pa.array(hit))

    return differ.mapInArrow(work, differ.schema)


def _chunks(contexts: DataFrame) -> DataFrame:
    """``CHUNK`` contexts in a row, and how many windows they hold at most (their bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, total = TaskContext.get().partitionId() << 32, [], 0

        def pack() -> pa.RecordBatch:
            every = pa.Table.from_batches(held)
            key, anchor, begin, asks = (every.column(c).to_numpy() for c in ("key", "anchor", "begin", "asks"))
            texts = every.column("bytes").to_pylist()
            facts = np.stack([key, anchor, begin, asks.astype(np.int64), np.array([len(t) for t in texts], np.int64)])
            return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int64()), "facts": [facts.tobytes()], "bytes": [b"".join(texts)], "size": pa.array([int(facts[4].sum())], pa.int64())})

        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(k, CHUNK)
                if total + piece.num_rows > CHUNK:
                    yield pack()
                    at, held, total = at + 1, [], 0
                if piece.num_rows:
                    held.append(piece)
                    total += piece.num_rows
        if total:
            yield pack()

    return contexts.select("key", "anchor", "begin", "asks", "bytes").mapInArrow(work, "chunk long, facts binary, bytes binary, size long")


def chunk_windows(facts: np.ndarray, raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a chunk's contexts: the context, the start in it, and a hash of the window and its anchor."""
    sizes = facts[4]
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(raw, np.uint8)
    rows, starts, ids = [], [], []
    for low in range(0, len(sizes), BLOCK):
        some = np.arange(low, min(low + BLOCK, len(sizes)))
        first, last = int(begins[some[0]]), int(begins[some[-1]] + sizes[some[-1]])
        hashes = gram_hashes(text[first:last], length)
        many = np.maximum(sizes[some] - length + 1, 0)
        row = np.repeat(some, many)
        start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        mixed = hashes[begins[row] - first + start] ^ (facts[1][row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows.append(row)
        starts.append(start)
        ids.append(mixed.view(np.int64))
    return tuple(np.concatenate(x) for x in (rows, starts, ids))


def _counted(chunks: DataFrame, length: int) -> DataFrame:
    """Ranges of contexts that ask, covered by windows that start at two places at least among all chunks.

    A chunk sends each of its windows once, whatever its number there: its place, or ``TWICE`` if the chunk itself
    has two. Buckets of windows answer a bit for each, in the order in which they were asked.
    """
    spark = chunks.sparkSession
    windows = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(spread(spark), parts_for(windows, FLUSH))

    def distinct(facts: bytes, raw: bytes) -> tuple:
        table = np.frombuffer(facts, np.int64).reshape(5, -1)
        row, start, ids = chunk_windows(table, raw, length)
        values, owner = np.unique(ids, return_inverse=True)
        order = np.argsort(values % buckets, kind="stable")
        return table, row, start, owner, values, order, np.searchsorted((values % buckets)[order], np.arange(buckets + 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, facts, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "facts", "bytes"))):
                table, row, start, owner, values, order, cuts = distinct(facts, raw)
                place = table[0][row] * np.int64(0x2545F4914F6CDD1D) + table[2][row] + start
                low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
                np.minimum.at(low, owner, place)
                np.maximum.at(high, owner, place)
                low[low != high] = TWICE
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    some = order[cuts[k] : cuts[k + 1]]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "payload": [values[some].tobytes() + low[some].tobytes()]})

    def answer(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(p, np.int64).reshape(2, -1) for p in group["payload"]]
        values, place = np.concatenate(parts, axis=1)
        order = np.argsort(values)
        sorted_values, sorted_place = values[order], place[order]
        new = np.append(True, sorted_values[1:] != sorted_values[:-1])
        first = np.flatnonzero(new)
        low, high = np.minimum.reduceat(sorted_place, first), np.maximum.reduceat(sorted_place, first)
        again = np.empty(len(values), bool)
        again[order] = ((low != high) | (low == TWICE))[np.cumsum(new) - 1]
        ends = np.cumsum([p.shape[1] for p in parts])
        bits = [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])]
        yield pd.DataFrame({"chunk": group["chunk"].to_numpy(), "bucket": group["bucket"].to_numpy(), "bits": bits})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for facts, raw, answers in zip(*(batch.column(c).to_pylist() for c in ("facts", "bytes", "answers"))):
                table, row, start, owner, values, order, cuts = distinct(facts, raw)
                again = np.zeros(len(values), bool)
                for a in answers:
                    some = order[cuts[a["bucket"]] : cuts[a["bucket"] + 1]]
                    again[some] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=len(some)).astype(bool)
                hit = np.flatnonzero(again[owner] & (table[3][row] == 1))
                if not len(hit):
                    continue
                row, start = row[hit], start[hit]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] - start[:-1] > length)))
                last = np.append(first[1:], len(hit)) - 1
                begin = table[2][row[first]]
                yield pa.RecordBatch.from_arrays([pa.array(table[0][row[first]]), pa.array(begin + start[first]), pa.array(begin + start[last] + length)], names=["key", "begin", "end"])

    sent = chunks.mapInArrow(send, "bucket long, chunk long, payload binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    bits = sent.mapInPandas(lambda frames: runs(frames, ["bucket"], answer), "chunk long, bucket long, bits binary")
    answers = bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return chunks.join(answers, "chunk").select("facts", "bytes", "answers").mapInArrow(mark, "key long, begin long, end long")


def _bucketed(source: DataFrame) -> DataFrame:
    """Key, id and text of every row in a table bucketed by key: joins with it by key leave the texts where they are."""
    spark = source.sparkSession
    name, buckets = f"texts_{uuid.uuid4().hex}", spread(spark)
    source.repartition(buckets, "key").write.bucketBy(buckets, "key").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def shared_extents(before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of bytes, how many of the first ones another row has too at most; the two are read and sorted apart."""

    def most(rows: np.ndarray) -> np.ndarray:
        order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        differ = rows[order[1:]] != rows[order[:-1]]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out = np.zeros(len(rows), np.int64)
        out[order[1:]] = common
        out[order[:-1]] = np.maximum(out[order[:-1]], common)
        return out

    return most(before), most(behind)


def trimmed(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, anchors_at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of anchors cut to what can lie in a repeated window: begins and ends in ``raw``, which holds them all.

    Equal windows have equal anchors in equal places, so a repeated one ends no later than the bytes from its anchor
    on that another context has too, and begins no earlier than those before the anchor's end. Bytes that
    are read past a context's edge can only make both longer.
    """
    edge = np.zeros(length, np.uint8)
    padded = np.concatenate([edge, raw, edge])
    at = anchors_at + length
    behind = np.lib.stride_tricks.sliding_window_view(padded, length)[at]
    back = np.lib.stride_tricks.sliding_window_view(padded[::-1], length)[len(padded) - at - gram]
    left, right = shared_extents(np.ascontiguousarray(back), np.ascontiguousarray(behind))
    return np.maximum(begins, anchors_at + gram - left), np.minimum(ends, anchors_at + right)


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Whole groups of equal ``anchor`` out of batches that come sorted by it, about ``size`` bytes of contexts at once."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = pa.concat_tables([*([rest] if rest else []), pa.Table.from_batches([batch])]).combine_chunks()
        anchor = rest.column("anchor").to_numpy()
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        sizes = pc.binary_length(rest.column("bytes")).to_numpy().astype(np.int64)
        part = (np.cumsum(sizes) - sizes)[first] // size
        cuts = first[np.append(True, part[1:] != part[:-1])].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest:
        yield rest


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key`` and ``spans`` of every document with repeated passages: ranges [from, to) of bytes, which may overlap."""
    source = _bodies(docs, text, doc_id)
    return _spans(source, _bucketed(source), length, gram)


def _spans(source: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    spark, reach = source.sparkSession, length - gram
    marked = stored(_marked(source, length, gram), "anchors")
    buckets = max(spread(spark), parts_for(marked.count(), FLUSH))
    known = stored(_known(marked, buckets), "known")
    seen = stored(_seen(marked, known, length), "seen")
    whole = seen.where("anchor IS NULL").select("key", "begin", "end")
    # Contexts that differ meet as texts: those that occur once, and one document's for each that repeats.
    differ = stored(_likely(seen.where("anchor IS NOT NULL"), buckets), "likely")
    once = differ.where(~F.col("repeated")).select("key", "anchor", "contexts", "at", "end", F.lit(True).alias("asks"))
    one = differ.where("repeated").groupBy("context", "anchor", "contexts").agg(F.min(F.struct("key", "at", "end")).alias("r"))
    asked = once.unionByName(one.select("r.key", "anchor", "contexts", "r.at", "r.end", F.lit(False).alias("asks")))
    # A document's contexts together are a few times its length at most.
    per_doc = asked.groupBy("key").agg(F.collect_list(F.struct("anchor", "contexts", "at", "end", "asks")).alias("wanted"))
    with_text = texts.join(per_doc.hint("merge"), "key").select("key", "body", "wanted")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["key", "anchor", "contexts", "at", "asks"]
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                rows: list[tuple] = []
                for r in batch.slice(k, 100).to_pylist():
                    raw = as_bytes(r["body"])
                    rows += [(r["key"], w["anchor"], w["contexts"], w["at"], w["asks"], raw[max(w["at"] - reach, 0) : w["end"]]) for w in r["wanted"]]
                arrays = [pa.array([r[i] for r in rows], pa.bool_() if f == "asks" else pa.int64()) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([r[5] for r in rows], pa.binary())], names=[*fields, "bytes"])

    cut = stored(with_text.mapInArrow(cut_out, "key long, anchor long, contexts long, at long, asks boolean, bytes binary"), "contexts")
    few = cut.where(F.col("contexts") <= MOST).repartition(spread(spark), "anchor").sortWithinPartitions("anchor")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for group in _groups(batches, TOGETHER):
            key, at, asks = (group.column(c).to_numpy() for c in ("key", "at", "asks"))
            texts = group.column("bytes").to_pylist()
            joint = b"".join(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            first = np.cumsum(sizes) - sizes
            low, high = trimmed(np.frombuffer(joint, np.uint8), first, first + sizes, first + np.minimum(at, reach), length, gram)
            some = np.flatnonzero(high - low >= length)
            if not len(some):
                continue
            begin = (np.maximum(at - reach, 0) + low - first)[some]
            owner = np.unique(key[some], return_inverse=True)[1].astype(np.int64)
            contexts = [joint[a:b] for a, b in zip(low[some].tolist(), high[some].tolist())]
            out: list[tuple] = []
            for k, b, asking, starts in zip(key[some].tolist(), begin.tolist(), asks[some].tolist(), repeated_starts(contexts, ((owner << 40) + begin).tolist(), length)):
                if asking and len(starts):
                    out += [(k, b + x, b + y) for x, y in covered(starts, length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["key", "begin", "end"])

    edges = few.mapInArrow(sort, "key long, begin long, end long")
    many = cut.where(F.col("contexts") > MOST).withColumn("begin", F.greatest(F.col("at") - reach, F.lit(0)))

    more = _counted(stored(_chunks(many), "chunks"), length)
    return whole.unionByName(edges).unionByName(more).groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal ranges covered by strings of ``length`` at sorted ``starts``."""
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cuts)]


def joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes that stay) and ``kept_sha256`` per row.

    * null and empty texts have no bytes; texts shorter than ``length`` lose nothing.
    * repeated rows and equal texts are occurrences of each other; a passage may repeat inside one text.
    * strings are judged on the input: all occurrences go. An empty table gives an empty result.
    * other columns are not read.
    """
    source = _bodies(docs, text, doc_id)
    texts = _bucketed(source)
    found = stored(_spans(source, texts, length, gram), "spans")
    both = texts.join(found.hint("merge"), "key", "left").select("doc_id", "body", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                rows = []
                for body, parts in zip(piece.column("body").to_pylist(), piece.column("spans").to_pylist()):
                    raw = as_bytes(body)
                    gone = joined([(s["begin"], s["end"]) for s in parts or ()])
                    ends = [0, *(b for _, b in gone)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(raw)]))
                    rows.append((len(raw), len(raw) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return both.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def report(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
