"""What several operators share: byte-level words, stored intermediate tables, streamed groups."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def as_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; a missing text is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+``.

    ``bytes.lower`` and ``bytes.split`` treat exactly the ASCII letters and these six bytes.
    """
    return as_bytes(text).lower().split()


_KEPT: dict = {}


def settle() -> None:
    """Called as a task begins or ends: what this worker kept for another stage goes, freed memory goes back to the system.

    Workers are used again by later stages, so without this they would hold the most that any stage has needed.
    """
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _KEPT.get("stage", stage) != stage:
        _KEPT.clear()
    _KEPT["stage"] = stage
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept(make: Callable[[str], object], path: str):
    """``make(path)``, made once per worker and stage."""
    settle()
    if path not in _KEPT:
        _KEPT[path] = make(path)
    return _KEPT[path]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of at most so many bytes goes to every task; a larger one is joined by a shuffle.
SMALL_BYTES = 16 << 20


def sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a stored table of rows of at most ``row_bytes``: marked for broadcast where its counted size is small."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle: the session's number, never under ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores added until no column has it (Spark ignores case)."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def runs(frames: Iterator[pd.DataFrame], keys: list[str], work: Callable[[pd.DataFrame], Iterator[pd.DataFrame] | None]) -> Iterator[pd.DataFrame]:
    """Call ``work`` with each group of equal ``keys`` out of frames that come sorted by them; holds one group."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        change = np.zeros(len(frame), bool)
        for k in keys:
            column = frame[k].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            piece = frame.iloc[a:b]
            if held and (a or any(held[-1][k].iloc[-1] != piece[k].iloc[0] for k in keys)):
                yield from work(pd.concat(held, ignore_index=True)) or ()
                held = []
            held.append(piece)
    if held:
        yield from work(pd.concat(held, ignore_index=True)) or ()


def with_columns(batch: pa.RecordBatch, values: dict) -> pa.RecordBatch:
    """``batch`` with columns replaced by ``values`` in the types the batch already has."""
    columns = [pa.array(values[f.name], f.type) if f.name in values else batch.column(i) for i, f in enumerate(batch.schema)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in batch.schema]))
