"""Places inside groups without one task per group.

A window function numbers a group in one task, however large it is. Here rows are dealt by group and slice of the ordering
value: slices are of nearly equal size over the whole table, so a group with a third of all rows is many tasks of a slice each.
Counts per group and slice, a small table, give the number of rows before each slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_side

#: Slices for every shuffle partition, so that those of one large group spread evenly over the tasks.
SLICES_PER_TASK = 4


def _number(rows: DataFrame, at: str) -> Column:
    kind = rows.schema[at].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(at).cast("timestamp")).cast("double")
    return F.col(at).cast("double")


def sliced(rows: DataFrame, at: str, slices: int | None = None, name: str = "_slice") -> DataFrame:
    """Rows with the number of their slice: greater for greater values of ``at``, the first one for nulls.

    The bounds come from a sketch of the column (one pass over it alone).
    """
    many = slices or SLICES_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = _number(rows, at)
    edges = rows.select(number.alias("_v")).agg(F.percentile_approx("_v", [k / many for k in range(1, many)], 10 * many)).first()[0] if many > 1 else None
    inner = sorted({e for e in edges or [] if e is not None})
    if not inner:
        return rows.withColumn(name, F.when(F.col(at).isNull(), -1).otherwise(0))
    cut = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_v", outputCol="_s", handleInvalid="keep")
    found = cut.transform(rows.withColumn("_v", number))
    return found.withColumn(name, F.when(F.col(at).isNull(), -1).otherwise(F.col("_s").cast("int"))).drop("_v", "_s")


def numbered(rows: DataFrame, by: Sequence[str], at: str, ties: Sequence[Column] = (), name: str = "seq", slices: int | None = None) -> DataFrame:
    """Rows with their place (from 1) in their group, ordered by ``at`` (nulls first), then by ``ties``.

    Without ties that tell all rows apart, equal rows are numbered in any order.
    """
    by = list(by)
    cut = sliced(rows, at, slices)
    counts = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_slice").alias("_o_slice"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    offsets = small_side(offsets.where(F.col("_before") > 0), cheap=True)  # a group inside one slice has nothing before it
    match = F.col("_slice") == F.col("_o_slice")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(F.col(at).asc_nulls_first(), *ties))
    placed = cut.withColumn("_n", inside).join(offsets, match, "left")
    return placed.withColumn(name, F.col("_n") + F.coalesce("_before", F.lit(0)).cast("bigint")).select(*rows.columns, name)
