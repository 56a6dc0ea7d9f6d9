"""WARC archives with a two-level capture index.

``write`` makes one record per page: a response with its payload, or a revisit (no payload) where a page with an
equal payload has a larger id. The files are plain WARC 1.1, written by Spark's text writer with the record
separator as line separator, so any store that Spark writes to holds them. ``read`` parses them again, one file
at a time, and checks every payload against its digest.

``write_index`` sorts the captures by reversed-host key and page and compresses them into blocks of ``LINES``; a
block's first key is kept beside it. ``search`` finds captures: the first keys of the index's parts say which part
holds a key, the first keys of that part's blocks which block, and only such blocks are unpacked and searched.
An entry names file, offset and length: ``fetch`` reads just that range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import parts_for, sent, spread, stored

FILE_BYTES = 16 << 20
LINES = 3000
PART_LINES = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a missing page id in keys, below every other.
NO_PAGE = -(1 << 63)
END = "\r\n"
CAPTURE = (
    "key string, page long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
)
FIELDS, TYPES = zip(*(f.split() for f in CAPTURE.split(", ")))


def base32(digest: Column) -> Column:
    """RFC 4648 letters of a SHA-1 in hexadecimal, 5 bytes at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(0, 40, 10):
        number = F.conv(F.substring(digest, k + 1, 10), 16, 10).cast("long")
        out += [F.substr(letters, F.shiftright(number, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*out)


def surt(url: str | None) -> str:
    """Reversed host, then port, path and query: pages of a host, and hosts of a domain, sort together."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + query


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with the body compressed, so that a shuffle of whole payloads writes less."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [None if b is None else zlib.compress(b) for b in batch.column("body").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("body"), "body", pa.array(bodies, pa.binary()))

    rows = rows.withColumn("body", F.col("body").cast("binary"))
    return rows.mapInArrow(work, rows.schema)


def unpacked(rows: DataFrame) -> DataFrame:
    """What ``packed`` had; the rows of a batch go on in pieces of ``FILE_BYTES`` or one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("body")
            begin, held, size = 0, [], 0
            for k in range(batch.num_rows):
                body = batch.column(at)[k].as_py()
                held.append(None if body is None else zlib.decompress(body))
                size += len(held[-1] or b"")
                if size >= FILE_BYTES or k + 1 == batch.num_rows:
                    yield batch.slice(begin, len(held)).set_column(at, "body", pa.array(held, pa.binary()))
                    begin, held, size = k + 1, [], 0

    return rows.mapInArrow(work, rows.schema).withColumn("body", F.col("body").cast("string"))


def write(pages: DataFrame, to: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One record per row of ``pages``.

    * a null payload is empty; payloads of ``least`` bytes and more are stored once, by the row with the largest
      id (rows that share it are all responses); without any id all are responses.
    * a null url becomes a name made of the id; control characters in it are written as blanks.
    * an empty table writes an empty archive; other columns are not read.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha1(F.col("body").cast("binary")), "bytes": F.octet_length("body").cast("long")})
    facts = stored(rows.select("id", "digest", "bytes"), "payloads")
    copies = facts.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    copies = sent(stored(copies.select("digest", "bytes", "first"), "copies"), 96)
    volume = facts.agg(F.sum(F.col("bytes") + 700)).first()[0] or 0
    rows = rows.join(copies, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("body")))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))
    target = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")))), r"[\x00-\x1F\x7F]", " ")
    record = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{END}WARC-Record-ID: "), name,
        F.lit(f"{END}WARC-Date: {DATE}{END}WARC-Target-URI: "), target,
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), base32(F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(END + END), block,
    )
    files = parts_for(int(volume), FILE_BYTES)
    rows = packed(rows.withColumn("body", F.when(~revisit, F.col("body"))))  # a revisit has no payload
    unpacked(rows.repartition(files, F.xxhash64("id", "url", "digest"))).select(record.alias("value")).write.option("lineSep", END + END).text(to)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of a file."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8", "replace").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        end = split + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end at {end}")
        yield at, end + 4 - at, headers, data[split + 4 : end]
        at = end + 4


def number(name: str) -> int | None:
    text = name.strip("<>").rpartition(":")[2]
    return None if text == "none" else int(text)


def capture(file: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    page = number(headers["WARC-Record-ID"])
    refers = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
    target = headers["WARC-Target-URI"]
    return surt(target), NO_PAGE if page is None else page, page, size, digest, kind, refers, file, offset, length


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, with its index key and place."""
    types = [pa.int64() if t == "long" else pa.string() for t in TYPES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                found = [capture(file, *record) for record in parse(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=list(FIELDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(work, CAPTURE)


def write_index(captures: DataFrame, to: str) -> None:
    """Sorted, compressed blocks of captures, each with the key that it begins with."""
    spark = captures.sparkSession
    parts = max(spread(spark), parts_for(captures.count(), PART_LINES))
    ordered = captures.repartitionByRange(parts, "key", "page").sortWithinPartitions("key", "page", "file", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, block = TaskContext.get().partitionId(), [], 0

        def pack(lines: list[dict]) -> pa.RecordBatch:
            payload = zlib.compress("\n".join(json.dumps([r[f] for f in FIELDS]) for r in lines).encode())
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "key": [lines[0]["key"]], "page": [lines[0]["page"]], "lines": [len(lines)], "payload": [payload]})

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= LINES:
                yield pack(held[:LINES])
                held, block = held[LINES:], block + 1
        if held:
            yield pack(held)

    ordered.mapInArrow(work, "part long, block long, key string, page long, lines long, payload binary").write.parquet(to)


def entries(payload: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(payload).decode().split("\n")]


def search(wanted: DataFrame, index: str) -> DataFrame:
    """All captures with the ``(key, page)`` pairs of ``wanted``.

    Only the first keys of the index's parts, one per shuffle partition, go to every task.
    """
    spark = wanted.sparkSession
    blocks = spark.read.parquet(index)
    firsts = sorted((r["m"]["key"].encode(), r["m"]["page"], r["part"]) for r in blocks.groupBy("part").agg(F.min(F.struct("key", "page")).alias("m")).collect())
    starts = spark.sparkContext.broadcast(([f[:2] for f in firsts], [f[2] for f in firsts]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts = starts.value
        for batch in batches:
            pairs = zip(batch.column("key").to_pylist(), batch.column("page").to_pylist())
            at = [bisect_right(keys, (k.encode(), p)) - 1 for k, p in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parts[max(0, i)] if parts else 0 for i in at], pa.int64())], names=["key", "page", "part"])

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("block")
        begins = [(k.encode(), p) for k, p in zip(right["key"], right["page"])]
        payloads, found, at = right["payload"].tolist(), [], -1
        for key, page in sorted((k.encode(), p) for k, p in zip(left["key"], left["page"])):
            # Equal keys may begin in the block before and go on over several.
            b = max(0, bisect_left(begins, (key, page)) - 1)
            while b < len(begins) and begins[b] <= (key, page):
                if b != at:
                    lines, at = entries(payloads[b]), b
                    order = [(x[0].encode(), x[1]) for x in lines]
                i = bisect_left(order, (key, page))
                while i < len(order) and order[i] == (key, page):
                    found.append(lines[i])
                    i += 1
                b += 1
        return pd.DataFrame({f: pd.array([x[i] for x in found], "Int64") if t == "long" else [x[i] for x in found] for i, (f, t) in enumerate(zip(FIELDS, TYPES))})

    queries = wanted.select("key", "page").distinct().mapInArrow(place, "key string, page long, part long")
    return queries.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(find, CAPTURE)


def keys_of(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Index keys of pages, as their records carry them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("page_id").to_pylist()
            urls = [f"urn:page:{'none' if i is None else i}" if u is None else u for i, u in zip(ids, batch.column("url").to_pylist())]
            urls = [u.translate(BLANKS) for u in urls]
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in urls]), pa.array([NO_PAGE if i is None else i for i in ids], pa.int64())], names=["key", "page"])

    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    return named.mapInArrow(work, "key string, page long")


BLANKS = {c: " " for c in (*range(0x20), 0x7F)}


def fetch(spark: SparkSession, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record: a range read through the file system that the path belongs to."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
    return next((headers, block) for _, _, headers, block in parse(data))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read and index them, and look every page up."""
    spark = pages.sparkSession
    archive, index = scratch_path(spark, "archive"), scratch_path(spark, "index")
    write(pages, archive, least)
    write_index(stored(read(spark, archive), "captures"), index)
    return search(keys_of(pages), index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
