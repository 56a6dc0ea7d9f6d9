"""Token ids in fixed-width bit-packed blocks.

A dataset is two Parquet folders. ``blocks`` has one row per block of at most ``BLOCK`` ids: ``part`` and
``block`` (their order is the order of the ids), ``at`` (position of its first id inside the part), ``n_ids``,
``bits`` (the fewest that hold every id of the vocabulary) and ``payload``: id number i is the ``bits`` bits
from bit ``i * bits`` on, lowest bit first, padded to whole bytes. The documents that end in a block are in
``doc_ids`` and ``doc_ends`` (position inside the part after their last id). ``parts`` has one row per part: its
number of ids and documents and ``base``, the ids of all parts before it. So id number n of the corpus is in the
part with the greatest ``base`` <= n, there in the block with the greatest ``at``, at a bit position that is
a product: any range unpacks by itself, vectorised.

Documents are range-partitioned by id, tokenised, packed and written in one pass; tasks keep one block. Blocks
are rows of Parquet, so any store that Spark reads holds them, and a lost executor leaves no half file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import kept, settle, spread

BLOCK = 1 << 16
#: Distinct units that a worker remembers the ids of.
REMEMBER = 450_000
#: Texts that are cut into units at once; the units and their numbers take many times the bytes of the texts.
PIECE = 250
#: Latin-1 letters that stay single letters in any normal form, and the lower-case ones of them.
LETTERS = re.compile(rb"[a-z\xDF-\xF6\xF8-\xFF]")
RUNS = re.compile(rb"[a-z\xDF-\xF6\xF8-\xFF]+|[^a-z\xDF-\xF6\xF8-\xFF\x09-\x0D\x20]+")
#: Those, digits, white space and signs, but for the apostrophe and the angle that special strings begin with.
SAFE = bytes([*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100), *range(0x30, 0x3A), *range(9, 14), *b' !"#$%&()*+,-./:;=>?@[]^_`{|}~'])
SCHEMA = T.StructType([
    T.StructField("part", T.LongType(), False), T.StructField("block", T.LongType(), False), T.StructField("at", T.LongType(), False),
    T.StructField("n_ids", T.LongType(), False), T.StructField("bits", T.IntegerType(), False), T.StructField("payload", T.BinaryType(), False),
    T.StructField("doc_ids", T.ArrayType(T.LongType()), False), T.StructField("doc_ends", T.ArrayType(T.LongType()), False),
])


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits % 8 == 0:  # whole bytes
        return np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    spread_out = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread_out.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids number ``first`` to ``last`` (not included) of a block, without reading what is before them."""
    if bits % 8 == 0:
        out = np.zeros((last - first, 4), np.uint8)
        out[:, : bits // 8] = np.frombuffer(payload, np.uint8)[first * bits // 8 : last * bits // 8].reshape(-1, bits // 8)
        return out.view("<u4").ravel().astype(np.uint32)
    bit = np.arange(first, last, dtype=np.int64) * bits
    raw = np.frombuffer(payload + bytes(8), np.uint8)
    word = np.zeros(len(bit), np.uint64)
    for k in range((bits + 7) // 8 + 1):
        word |= raw[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Numbers(dict):
    """Numbers of distinct units in the order they were met; the new ones wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, unit) -> int:
        found = self[unit] = len(self)
        self.new.append(unit)
        return found


def joint(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and where each ends."""
    ends = np.cumsum([len(ids) for ids in found], dtype=np.int64)
    return np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1]) if len(ends) else 0), ends


class Encoder:
    """Ids of texts by one tokenizer file; a worker sends each distinct word through the library once.

    Words end at ASCII white space. That is only done where no token can span it: the pre-tokenizer drops
    white space and no special token holds any. Where it also cuts between letters and signs, a text of plain
    characters goes by runs of either.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        drops = cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and bool(cuts[0].get("invert"))
        apart = all(t["content"].split() == [t["content"]] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
        self.by_word = drops and apart and all(not self.tool.encode(c, add_special_tokens=False).ids for c in " \t\n\r\x0b\x0c")
        # Where every piece ends in one token that only ends pieces, runs of plain letters can be encoded together.
        suffix = spec["model"].get("end_of_word_suffix")
        pieces = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.by_piece = self.by_word and bool(suffix) and cuts[0].get("pattern") == {"Regex": pieces}
        # Letters a to z then reach the library's model as they are, so a run of them needs nothing before it.
        normal = spec.get("normalizer") or {}
        steps = [n["type"] for n in normal.get("normalizers", [normal] if normal else [])]
        blanks = all(n.get("pattern") == {"Regex": r"\s+"} for n in normal.get("normalizers", [normal]) if n.get("type") == "Replace")
        level = cuts[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.bare = self.by_piece and level and blanks and {*steps} <= {"NFC", "Replace", "Lowercase"} and not any(re.fullmatch("[a-z]+", t["content"]) for t in spec.get("added_tokens", []))
        self.vocabulary = max(self.tool.get_vocab(with_added_tokens=True).values()) + 1
        self.ends = np.zeros(self.vocabulary, bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.rows = np.zeros(0, np.int64)  # where the ids of each number are: between starts[row] and starts[row + 1]
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = self.filled = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Store the joined ``ids`` of new units that end at ``ends``; the rows they have then."""
        n = self.filled
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(ends) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + len(ends) + 1] = self.used + ends
        self.used += len(ids)
        self.filled += len(ends)
        return np.arange(n, n + len(ends))

    def learn(self, new: list) -> None:
        """Units are words as text, or runs of plain letters or of signs in Latin-1."""
        plain, bare, whole = [], [], []
        for i, u in enumerate(new):
            if not isinstance(u, bytes) or not LETTERS.match(u):
                whole.append(i)
            elif self.bare and u.isascii():
                bare.append(i)
            else:
                plain.append(i)
        rows = np.zeros(len(new), np.int64)
        tokenize = self.tool.model.tokenize
        found = [[t.id for t in tokenize(new[i].decode("ascii"))] for i in bare]
        rows[bare] = self.add(*joint(found))
        together = [plain[k : k + 2000] for k in range(0, len(plain), 2000)]
        texts = [b" ".join([new[i] for i in some]).decode("latin-1") for some in together]
        for some, encoding in zip(together, self.tool.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                rows[some] = self.add(ids, ends)
            else:
                whole += some
        texts = [new[i].decode("latin-1") if isinstance(new[i], bytes) else new[i] for i in whole]
        found = [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        rows[whole] = self.add(*joint(found))
        self.rows = np.concatenate([self.rows, rows])

    def units(self, text: str) -> list:
        """What a text is encoded by: runs of letters and signs where all characters are plain, else words."""
        if self.by_piece:
            try:
                raw = text.lower().encode("latin-1")
                if not raw.translate(None, SAFE):
                    return RUNS.findall(raw)
            except UnicodeEncodeError:
                pass
        for blank in "\t\n\r\v\f":
            text = text.replace(blank, " ")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.units(t) for t in texts]
        every = [u for units in split for u in units]
        if len(self.number) > REMEMBER:
            self.forget()
        numbers = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        if self.number.new:
            new, self.number.new = self.number.new, []
            self.learn(new)
        rows = self.rows[numbers]
        start = self.starts[rows]
        size = self.starts[rows + 1] - start
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.append(0, ends)[np.cumsum([len(u) for u in split])[:-1]]) if texts else []


def write(docs: DataFrame, path: str, to: str, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> None:
    """Tokenise ``docs`` in ascending ``doc_id`` order into the dataset ``to``.

    * null and empty texts have no ids but the end id; a document may span any number of blocks.
    * a null id sorts first and is kept as null; equal ids are ordered by their text's hash.
    * an empty table writes an empty dataset; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("h", F.xxhash64("body"))
    ranged = rows.repartitionByRange(parts or spread(spark), "id", "h").sortWithinPartitions("id", "h", "body")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = kept(Encoder, path), TaskContext.get().partitionId()
        bits = width(max(tool.vocabulary, (end_id or 0) + 1))
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        block = at = position = held = 0
        pieces: list[np.ndarray] = []
        ids: list[int | None] = []
        ends: list[int] = []

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, at, held, pieces, ids, ends
            joined = np.concatenate([*pieces, np.zeros(0, np.uint32)])
            cuts = list(range(0, len(joined) - BLOCK + 1, BLOCK))
            done = cuts[-1] + BLOCK if cuts else 0
            if last and (done < len(joined) or ids):
                cuts.append(done)
            for k in cuts:
                values = joined[k : k + BLOCK]
                here = len(ends) if last and k == cuts[-1] else int(np.searchsorted(ends, at + len(values), side="right"))
                yield pa.RecordBatch.from_pydict(
                    {"part": [part], "block": [block], "at": [at], "n_ids": [len(values)], "bits": [bits], "payload": [pack(values, bits)], "doc_ids": [ids[:here]], "doc_ends": [ends[:here]]},
                    schema=ARROW,
                )
                ids, ends = ids[here:], ends[here:]
                block, at = block + 1, at + len(values)
            joined = joined[done:] if not last else joined[:0]
            pieces, held = [joined], len(joined)

        for batch in batches:
            for k in range(0, batch.num_rows, PIECE):
                piece = batch.slice(k, PIECE)
                for i, found in zip(piece.column("id").to_pylist(), tool.encode(piece.column("body").to_pylist())):
                    pieces += [found, tail]
                    held += len(found) + len(tail)
                    position += len(found) + len(tail)
                    ids.append(i)
                    ends.append(position)
                if held >= 4 * BLOCK:
                    yield from full(False)
        yield from full(True)
        settle()

    ranged.select("id", "body").mapInArrow(work, SCHEMA).write.parquet(f"{to}/blocks")
    totals = spark.read.parquet(f"{to}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.sum(F.size("doc_ids")).alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part, however many ids there are
    totals.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{to}/parts")


ARROW = pa.schema([
    ("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())),
])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Read a dataset back: a row per document with its first position, number of ids and their CRC-32.

    A document's ids may lie in several blocks, so each part's blocks are read in order by one task, one at a time.
    """
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/parts").select("part", "base")), "part")
    ordered = blocks.repartition(spread(spark), "part").sortWithinPartitions("part", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, crc = None, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["part"] != part:
                    part, begun, crc = r["part"], 0, 0
                values, at, done = unpack(r["payload"], r["bits"], 0, r["n_ids"]), r["at"], 0
                for doc, end in zip(r["doc_ids"], r["doc_ends"]):
                    crc = zlib.crc32(values[done : end - at].astype("<u4").tobytes(), crc)
                    rows.append((doc, r["base"] + begun, end - begun, crc))
                    begun, done, crc = end, end - at, 0
                crc = zlib.crc32(values[done:].astype("<u4").tobytes(), crc)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return ordered.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_between(spark: SparkSession, path: str, first: int, last: int) -> np.ndarray:
    """Ids number ``first`` to ``last`` (not included) of the corpus: reads only the blocks that hold them."""
    parts = spark.read.parquet(f"{path}/parts").where((F.col("base") < last) & (F.col("base") + F.col("n_ids") > first))
    out = [np.zeros(0, np.uint32)]
    for p in parts.orderBy("base").toLocalIterator():
        a, b = max(0, first - p["base"]), min(p["n_ids"], last - p["base"])
        blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks").where((F.col("part") == p["part"]) & (F.col("at") < b) & (F.col("at") + F.col("n_ids") > a))
        for r in blocks.select("at", "n_ids", "bits", "payload").orderBy("at").toLocalIterator():
            out.append(unpack(bytes(r["payload"]), r["bits"], max(0, a - r["at"]), min(r["n_ids"], b - r["at"])))
    return np.concatenate(out)


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to the shared folder and return what the files say."""
    spark = docs.sparkSession
    to = scratch_path(spark, "tokens")
    write(docs, path, to, end_id)
    return documents(spark, to)
