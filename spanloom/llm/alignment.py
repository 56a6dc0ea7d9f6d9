"""Alignment of two tokenizers over the same texts.

Both tokenizers cut ``" " + text`` into byte ranges. Every token points to the farthest-right token of the other side that overlaps
it, as long as that reaches farther; doubling the pointers of all tokens at once ends at the last token of each component, which
names its group. Groups therefore end where tokens of both sides end.

A worker aligns each distinct unit once and remembers it. Units are cut before a space that follows something other than white space:
no token of either side spans such a place (checked for every vocabulary when it is loaded), so the tokens of a text are those
of its units, one after the other. A text with a unit whose tokens do not give its bytes back is aligned as a whole.

How many documents hold a linked pair of ids is counted over the corpus. ``TOP`` pairs with the highest counts go to every task, the
others are joined by pair; together they cover all.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, kept, settle, spread, stored

#: Pairs of ids that go to every task (at most 21 bytes each), units that a worker remembers, characters worked on at once.
TOP, REMEMBER, PIECE = 1_000_000, 300_000, 1 << 21
#: Pairs that are expanded or counted at once.
FLUSH = 1 << 22
#: Where texts are cut, and what only that expression finds right.
CUT, ODD = re.compile(r"(?<=\S) (?!\Z)"), re.compile(r"\s | \Z")
LOW = (1 << 32) - 1


class ByteLevel:
    """Ids of byte-level BPE, each distinct word through the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE that splits words and changes no text")
        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = True
        # Printable bytes stand for themselves, the others for letters from U+0100 on, in order.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(own)]
        letter = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}
        vocabulary = self.tool.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids of a sentencepiece model for texts that begin with a space, which the model itself puts there."""

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size())]
        # A space that follows something else is never inside a piece, spaces are kept, and a first one is added.
        if any(re.search("[^▁]▁", p) for p in pieces) or self.tool.encode("a  b ", out_type=str)[0] != "▁a" or "".join(self.tool.encode("a  b ", out_type=str)) != "▁a▁▁b▁":
            raise ValueError("only models that keep spaces and join none to what is before it")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tool.encode([t[1:] for t in texts], num_threads=1)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every token of A, then of B, the number of the B token that ends its component; both sides end at the same place."""
    if not len(ends_b):
        return np.zeros(0, np.int64)
    n = len(ends_a)
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    # Ranges cover the text without a gap, so the farthest token that overlaps is the last that starts before the end.
    far_b = np.searchsorted(starts_b, ends_a, side="left") - 1
    far_a = np.searchsorted(starts_a, ends_b, side="left") - 1
    own = np.arange(n, n + len(ends_b))
    after = np.concatenate([far_b + n, np.where(ends_a[far_a] > ends_b, far_a, own)])
    while True:
        further = after[after]
        if (further == after).all():
            return after - n
        after = further


def distinct(key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often (or with what sum of ``times``) each occurs."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if times is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.diff(np.append(first, len(key))) if times is None else np.add.reduceat(times, first)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start .. start + size``, one after the other."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def pack(code: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pair codes as differences and their multiplicities, byte by byte of equal weight: number of pairs, width of the latter, planes."""
    gaps = np.diff(code, prepend=0).astype("<u4")
    wide = 1 if times.max(initial=0) < 1 << 8 else 8
    planes = [gaps.view(np.uint8).reshape(-1, 4).T, np.ascontiguousarray(times, f"<u{wide}").view(np.uint8).reshape(-1, wide).T]
    return np.array([len(code), wide], "<u4").tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in planes)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide = np.frombuffer(packed, "<u4", 2).tolist()
    raw = np.frombuffer(packed, np.uint8, offset=8)
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    times = np.ascontiguousarray(raw[4 * n :].reshape(wide, n).T).view(f"<u{wide}").ravel()
    return np.cumsum(gaps, dtype=np.int64), times.astype(np.int64)


class Units:
    """What is known of units, by number: whether their bytes come back, sizes, the groups as text, linked pairs."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.sound = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.at = np.zeros(1, np.int64)  # where the pairs of a unit begin
        self.code, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.groups) > REMEMBER or self.chars > 32 * REMEMBER or len(self.code) > 8 * REMEMBER


class Aligner:
    """Two tokenizer files, compiled once per worker."""

    def __init__(self, paths: tuple[str, str]):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = ByteLevel(paths[0]), Pieces(paths[1])
        self.size_a, self.size_b = (np.array([len(t) for t in side.bytes]) for side in (self.a, self.b))
        self.name = np.array([str(i) for i in range(max(len(self.size_a), len(self.size_b)))], object)
        if len(self.size_a) * len(self.size_b) >= 1 << 32:
            raise ValueError("pairs of ids must fit in 32 bits")
        self.known = Units()

    def add(self, units: list[str], known: Units) -> None:
        """Align ``units``, each for itself, and append what is found to ``known``."""
        both = list(zip(self.a.encode(units), self.b.encode(units)))
        sound = [b"".join(map(self.a.bytes.__getitem__, a)) == b"".join(map(self.b.bytes.__getitem__, b)) == u.encode() for u, (a, b) in zip(units, both)]
        both = [pair if ok else ([], []) for pair, ok in zip(both, sound)]
        n_a, n_b = (np.array([len(p[k]) for p in both], np.int64) for k in (0, 1))
        a, b = (np.fromiter((i for p in both for i in p[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        last = terminals(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        ends = np.flatnonzero(last[len(a) :] == np.arange(len(b)))  # one B token ends each group
        group_a, group_b = np.searchsorted(ends, last[: len(a)]), np.searchsorted(ends, last[len(a) :])
        per_a, per_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        owner = np.repeat(np.arange(len(units)), n_b)[ends]
        n_links = np.zeros(len(units), np.int64)
        np.add.at(n_links, owner, per_a * per_b)
        known.sound = np.append(known.sound, sound)
        known.sizes = np.vstack([known.sizes, np.stack([n_a, n_b, np.bincount(owner, minlength=len(units)), n_links], axis=1)])
        known.chars += sum(map(len, units))
        self.write(known, a, b, group_a, group_b, per_a, per_b, n_a + n_b)
        self.pairs(known, a, b, group_a, group_b, owner, len(units))

    def write(self, known, a, b, group_a, group_b, per_a, per_b, tokens) -> None:
        """``a1,a2|b1;a3|b2`` of every unit."""
        place = np.concatenate([np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a], np.arange(len(b)) + np.cumsum(per_a)[group_b]])
        out = np.empty(len(place), object)
        text_a, text_b = self.name[a] + ",", self.name[b] + ","
        end_a, end_b = np.cumsum(per_a) - 1, np.cumsum(per_b) - 1
        text_a[end_a] = self.name[a[end_a]] + "|"
        text_b[end_b] = self.name[b[end_b]] + ";"
        out[place] = np.concatenate([text_a, text_b])
        out = out.tolist()
        at = np.append(0, np.cumsum(tokens)).tolist()
        known.groups += ["".join(out[i:j])[:-1] for i, j in zip(at, at[1:])]

    def pairs(self, known, a, b, group_a, group_b, owner, count: int) -> None:
        """Distinct linked pairs of every unit and how often each is linked: distinct ids per group, then their products."""
        wide_a, wide_b = len(self.size_a), len(self.size_b)
        key_a, times_a = distinct(group_a * wide_a + a)
        key_b, times_b = distinct(group_b * wide_b + b)
        id_b = key_b % wide_b
        have_b = np.bincount(key_b // wide_b, minlength=len(owner))
        start_b = np.cumsum(have_b) - have_b
        of, partners = key_a // wide_a, have_b[key_a // wide_a]
        begin, parts = 0, []
        reach = np.cumsum(partners)
        while begin < len(key_a):  # so many left sides at once that their products stay small, one at least
            stop = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + FLUSH, side="right")))
            right = spans(start_b[of[begin:stop]], partners[begin:stop])
            left = np.repeat(np.arange(begin, stop), partners[begin:stop])
            code = (key_a[left] % wide_a) * wide_b + id_b[right]
            parts.append((owner[of[left]], code, times_a[left] * times_b[right]))
            begin = stop
        unit, code, times = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        key, times = distinct((unit << 32) | code, times)
        known.at = np.append(known.at, len(known.code) + np.searchsorted(key >> 32, np.arange(1, count + 1)))
        known.code, known.times = np.append(known.code, key & LOW), np.append(known.times, times)

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the units of each text; new units are aligned together."""
        if self.known.full():
            self.known = Units()
        known, out = self.known, []
        new: dict[str, int] = {}
        base = len(known.groups)
        for text in texts:
            row = []
            for unit in units(text):
                k = known.number.get(unit)
                row.append(new.setdefault(unit, base + len(new)) if k is None else k)
            out.append(row)
        if new:
            self.add(list(new), known)
            known.number |= new
        return out

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, bytes]]:
        """Tokens of A and B, groups, links, groups as text and packed pairs of every text."""
        rows = self.numbers([" " + t if t else "" for t in texts])
        known = self.known
        out = self.summed(known, rows)
        every = np.fromiter((k for row in rows for k in row), np.int64)
        broken = np.repeat(np.arange(len(rows)), [len(row) for row in rows])[~known.sound[every]]
        for k in np.unique(broken).tolist():
            alone = Units()
            self.add([" " + texts[k]], alone)
            out[k] = self.summed(alone, [[0]])[0]
        return out

    @staticmethod
    def summed(known: Units, rows: list[list[int]]) -> list[tuple[int, int, int, int, str, bytes]]:
        counts = np.array([len(row) for row in rows], np.int64)
        key, uses = distinct((np.repeat(np.arange(len(rows)), counts) << 32) | np.fromiter((k for row in rows for k in row), np.int64, int(counts.sum())))
        row, unit = key >> 32, key & LOW
        sizes = np.zeros((len(rows), 4), np.int64)
        np.add.at(sizes, row, known.sizes[unit] * uses[:, None])
        have = known.at[unit + 1] - known.at[unit]
        place = spans(known.at[unit], have)
        key, times = distinct((np.repeat(row, have) << 32) | known.code[place], known.times[place] * np.repeat(uses, have))
        at = np.searchsorted(key >> 32, np.arange(len(rows) + 1)).tolist()
        key &= LOW
        groups = [";".join(filter(None, map(known.groups.__getitem__, r))) for r in rows]
        return [(*size, text, pack(key[i:j], times[i:j])) for size, text, i, j in zip(sizes.tolist(), groups, at, at[1:])]


def units(text: str) -> list[str]:
    """A text cut before every space that follows something other than white space and is not the end."""
    if not text or not ODD.search(text):
        return [" " + u for u in text.split(" ")[1:]]
    cuts = [m.start() for m in CUT.finditer(text)]
    return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]


ADDED = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(), "pairs": T.BinaryType()}


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2``) and ``pairs`` added.

    ``pairs`` holds the distinct linked pairs, ``id_a * size of B + id_b``, with their number of links (``unpack``).

    * a text that is null, empty, or not given back byte for byte by both sides has no tokens: zeros, empty groups, no pairs.
    * texts of any length are aligned whole; a group of many tokens gives products of its distinct ids only.
    * every row is aligned by itself, so repeated rows repeat; an empty table gives an empty result.
    * other columns pass through, also with these names (the new ones then get underscores).
    """
    names = [free_name(n, docs.columns) for n in ADDED]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t, False) for n, t in zip(names, ADDED.values()))])
    types = [pa.int64()] * 4 + [pa.large_string(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = kept(Aligner, (path_a, path_b))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            begin = size = 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= PIECE or k + 1 == len(texts):
                    found = tool.align(texts[begin : k + 1])
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                    columns[4] = columns[4].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, k + 1 - begin).columns, *columns], names=[*batch.schema.names, *names])
                    begin, size = k + 1, 0

    return docs.mapInArrow(work, schema)


def pair_counts(aligned: DataFrame, pairs: str, width: int) -> DataFrame:
    """``code``, ``n`` (rows that hold the pair) and ``best`` (none with this A id has more), for the pairs of all rows; ``width``: ids of B."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: list[np.ndarray] = []
        total = 0
        sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged():
            code, n = distinct(np.concatenate(held) if held else np.zeros(0, np.int64))
            return distinct(np.concatenate([sums[0], code]), np.concatenate([sums[1], n]))

        def rows(code, n):
            for at in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_pydict({"code": code[at : at + (1 << 16)], "n": n[at : at + (1 << 16)]})

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(unpack(packed)[0])
                total += len(held[-1])
                if total >= FLUSH:
                    sums, held, total = merged(), [], 0
                    if len(sums[0]) >= FLUSH:
                        yield from rows(*sums)
                        sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from rows(*merged())

    counts = aligned.select(pairs).mapInArrow(local, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pair-counts")
    # One row per id of A: bounded by its vocabulary.
    highest = counts.groupBy(F.expr(f"code div {width}").alias("a")).agg(F.max("n").alias("highest"))
    return counts.withColumn("a", F.expr(f"code div {width}")).join(F.broadcast(highest), "a").select("code", "n", (F.col("n") == F.col("highest")).alias("best"))


class Top:
    """Counts of the most frequent pairs, sorted by pair."""

    def __init__(self, table: pa.Table):
        code, self.n, self.best = (table.column(c).to_numpy() for c in ("code", "n", "best"))
        order = np.argsort(code)
        self.code, self.n, self.best = code[order], self.n[order], self.best[order].astype(bool)


def best_links(aligned: DataFrame, key: str, pairs: str, width: int) -> DataFrame:
    """``key``, ``n_best`` (links whose pair has the highest count of its A id) and ``count_sum`` (counts over links) of every row with pairs.

    ``key`` must be unique; ``aligned`` is read several times and should be stored.
    """
    spark = aligned.sparkSession
    counts = stored(pair_counts(aligned, pairs, width), "pairs")
    # The least count that at most TOP pairs reach; the frequencies of counts above it are no more than TOP rows.
    least, total = None, 0
    for n, having in counts.groupBy("n").agg(F.count(F.lit(1)).alias("having")).orderBy(F.desc("n")).limit(TOP).toLocalIterator():
        if total + having > TOP:
            break
        least, total = n, total + having
    common = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    top = spark.sparkContext.broadcast(Top(common.toArrow()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        table = top.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 500):
                both = [unpack(p) for p in batch.column(1).slice(at, 500).to_pylist()]
                code, times = (np.concatenate([b[k] for b in both]) for k in (0, 1))
                sizes = np.array([len(b[0]) for b in both])
                row = np.repeat(np.arange(len(both)), sizes)
                place = np.minimum(np.searchsorted(table.code, code), max(0, len(table.code) - 1))
                met = table.code[place] == code if len(table.code) else np.zeros(len(code), bool)
                n_best = np.bincount(row[met], times[met] * table.best[place[met]], len(both)) if met.any() else np.zeros(len(both))
                total = np.zeros(len(both), np.int64)
                np.add.at(total, row[met], times[met] * table.n[place[met]] if met.any() else 0)
                own = np.array(keys[at : at + 500], np.int64)
                # What a row has found here stands under a pair of its own that no count has.
                yield pa.RecordBatch.from_pydict({
                    "key": np.concatenate([own, own[row[~met]]]), "code": np.concatenate([-1 - own, code[~met]]), "times": np.concatenate([np.zeros(len(own), np.int64), times[~met]]),
                    "n_best": np.concatenate([n_best.astype(np.int64), np.zeros((~met).sum(), np.int64)]), "count_sum": np.concatenate([total, np.zeros((~met).sum(), np.int64)]),
                })

    found = aligned.select(F.col(key).alias("key"), pairs).mapInArrow(look, "key long, code long, times long, n_best long, count_sum long")
    rest = (counts.where(F.col("n") < least) if least is not None else counts).select("code", "n", "best")
    joined = found.join(rest, "code", "left")
    nothing = F.lit(0).cast("long")
    joined = joined.select(
        "key", (F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(nothing)).alias("n_best"), (F.col("count_sum") + F.col("times") * F.coalesce("n", nothing)).alias("count_sum")
    )
    return joined.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).withColumnRenamed("key", key)


def report(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest columns of every row of ``docs``: sizes, best links, sum of counts, and the SHA-256 of ``groups`` (empty without tokens)."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = align(source, path_a, path_b).drop("text").withColumn("key", F.monotonically_increasing_id())
    found = stored(found.withColumn("groups", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).withColumnRenamed("groups", "groups_sha256"), "aligned")
    sums = best_links(found, "key", "pairs", width)
    return found.drop("pairs").join(sums, "key").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
