"""Relative time ranges (``now-15m``, ``now-24h/now-15m``) as predicates.

Bounds are built as literals of the column's own type, so they fold to constants
and reach the Parquet scan; a stored ``event_date`` partition is pruned as well.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PARTITION_COLUMN

_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "M": "MONTH", "y": "YEAR"}
_STEP = re.compile(r"([+-])(\d+)([smhdwMy])")
_RELATIVE = re.compile(r"now(?:[+-]\d+[smhdwMy])*")


def instant(text: str, as_of: str | datetime | None = None, dtype: T.DataType | None = None) -> Column:
    """``text`` (relative to ``as_of``, or an absolute time) as a constant column."""
    dtype = dtype or T.TimestampType()
    text = text.strip()
    if not _RELATIVE.fullmatch(text):
        if text.startswith("now"):
            raise ValueError(f"unreadable time: {text!r}")
        return F.lit(text).cast(dtype)
    base = F.current_timestamp() if as_of is None else F.lit(str(as_of))
    bound = base.cast(dtype)
    for sign, amount, unit in _STEP.findall(text):
        step = F.expr(f"INTERVAL {amount} {_UNITS[unit]}")
        bound = bound + step if sign == "+" else bound - step
    return bound


def _dtype(df: DataFrame, ts: str) -> T.DataType:
    return df.schema[ts].dataType


def at_least(df: DataFrame, text: str, as_of=None, ts: str = "ts") -> Column:
    """Current window: from ``text`` on, no upper bound."""
    bound = instant(text, as_of, _dtype(df, ts))
    keep = F.col(ts) >= bound
    if PARTITION_COLUMN in df.columns:
        keep = keep & (F.col(PARTITION_COLUMN) >= bound.cast("date"))
    return keep


def at_most(df: DataFrame, text: str, as_of=None, ts: str = "ts") -> Column:
    bound = instant(text, as_of, _dtype(df, ts))
    keep = F.col(ts) <= bound
    if PARTITION_COLUMN in df.columns:
        keep = keep & (F.col(PARTITION_COLUMN) <= bound.cast("date"))
    return keep


def split_range(text: str, default_from: str, default_to: str) -> tuple[str, str]:
    """``a/b`` into its two anchors; a missing one takes its default."""
    parts = [part.strip() for part in (text or "").split("/") if part.strip()]
    return (parts[0] if parts else default_from), (parts[1] if len(parts) > 1 else default_to)


def within(df: DataFrame, text: str, as_of=None, ts: str = "ts", default_from="now-24h", default_to="now") -> Column:
    """Baseline window ``a/b``, both ends included."""
    low, high = split_range(text, default_from, default_to)
    return at_least(df, low, as_of, ts) & at_most(df, high, as_of, ts)


def bucket(df: DataFrame, interval: str, ts: str = "ts") -> Column:
    """Start of the fixed-width time bucket of a row."""
    return F.window(F.col(ts), interval)["start"]
