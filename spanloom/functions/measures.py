"""Small column helpers shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def failed() -> Column:
    return F.col("event_outcome") == "failure"


def internal(mode: str = "all") -> Column:
    """Rows the platform wrote about itself: every ``internal.`` dataset, or only sanity checks."""
    dataset = F.col("event_dataset")
    if mode == "all":
        return F.coalesce(dataset.startswith("internal."), F.lit(False))
    if mode == "sanity":
        return F.coalesce(dataset == "internal.sanity_check", F.lit(False))
    if mode == "none":
        return F.lit(False)
    raise ValueError(f"internal must be 'all', 'sanity' or 'none', not {mode!r}")


def keep_external(df, mode: str = "all"):
    return df if mode == "none" else df.where(~internal(mode))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def total(column: Column | str) -> Column:
    """Sum that is 0 when nothing is there."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(column), F.lit(0))


def money(column: Column | str) -> Column:
    """Cost as a decimal, so that a sum does not depend on the order of its rows."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(20,9)")


def exact(column: Column | str) -> Column:
    """Latency or score as a decimal, for the same reason."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(20,6)")


def mean(column: Column | str) -> Column:
    """Order-independent average as a double, null when nothing is there."""
    return F.try_divide(F.sum(exact(column)).cast("double"), F.count(column).cast("double"))


def average(total_column: str, count_column: str) -> Column:
    """The same from an exact sum and a count that are already there."""
    return F.try_divide(F.col(total_column).cast("double"), F.col(count_column).cast("double"))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def fixed(column: Column, digits: int) -> Column:
    """Decimal rounding (half up) of a double, returned as a double."""
    return F.round(column.cast(f"decimal(30,{digits + 4})"), digits).cast("double")


def clamp(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def top_key(entries: str, field: str = "key") -> Column:
    """First entry of a ranked evidence list, null when the list is empty."""
    return F.try_element_at(F.col(entries), F.lit(1))[field]
