"""Difference between declared and live JSON documents, for many documents at once.

Trees of hashes: every document has one for its whole text, and only documents whose hashes differ are brought together. From
there on both sides of a path stand in one row; a subtree that reads the same on both sides stops at its root, the others are
opened, one level per round. So the work follows what differs, and no level is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side, spread

_OBJECT = "map<string,variant>"
_LIST = "array<variant>"


def unequal(local: DataFrame, remote: DataFrame, key: str, body: str) -> DataFrame:
    """``key, v, w``: both sides of the documents that are in both tables and do not have the same text."""
    # Dealt by key in full: a few input splits can hold many times their size in members.
    many = spread(local.sparkSession)
    ours, theirs = (df.select(F.col(key).alias("_k"), F.col(body).cast("string").alias("_b")) for df in (local, remote))
    marked = ours.select("_k", F.sha2("_b", 256).alias("_h")).join(theirs.select("_k", F.sha2("_b", 256).alias("_g")), "_k")
    apart = small_side(marked.where(~F.col("_h").eqNullSafe(F.col("_g"))).select("_k").distinct(), cheap=True)
    left, right = ours.join(apart, "_k", "left_semi"), theirs.join(apart, "_k", "left_semi").withColumnRenamed("_b", "_c")
    both = left.repartition(many, "_k").join(right.repartition(many, "_k"), "_k").where(~F.col("_b").eqNullSafe(F.col("_c")))
    return both.select(F.col("_k").alias(key), F.try_parse_json("_b").alias("v"), F.try_parse_json("_c").alias("w"))


def _opened(level: DataFrame) -> DataFrame:
    """Kind of both sides, and their members where one is a container."""
    rows = level
    for side in "vw":
        rows = rows.withColumn(f"{side}o", F.try_variant_get(side, "$", _OBJECT)).withColumn(f"{side}l", F.try_variant_get(side, "$", _LIST))
        rows = rows.withColumn(f"{side}k", F.when(F.col(f"{side}o").isNotNull(), "object").when(F.col(f"{side}l").isNotNull(), "list").otherwise("value"))
    return rows


def _same(left: Column, right: Column) -> Column:
    """Equal text, or equal numbers written differently; integers are compared digit by digit."""
    whole = left.rlike(r"^-?\d+$") & right.rlike(r"^-?\d+$")
    exact = left.try_cast("decimal(38,0)") == right.try_cast("decimal(38,0)")
    near = left.try_cast("double") == right.try_cast("double")
    return (left == right) | F.coalesce(F.when(whole, exact).otherwise(near), F.lit(False))


def drift(local: DataFrame, remote: DataFrame, key: str = "asset", body: str = "body") -> DataFrame:
    """Differences ``key, path, type, local, remote``; only what ``local`` declares is compared.

    A missing object is reported once, at its top; lists of different length are
    reported and compared as far as both go.
    """
    # "has": the remote side has this path; "inside": its parent there is an object, so a member can be missing.
    level = unequal(local, remote, key, body).select(key, F.lit("").alias("path"), "v", "w", F.lit(True).alias("has"))
    size = lambda side: F.coalesce(F.size(f"{side}o"), F.size(f"{side}l"))
    kind = (
        F.when(~F.col("has"), "missing_in_remote")
        .when(F.col("vk") != F.col("wk"), "value_mismatch")
        .when((F.col("vk") == "list") & (size("v") != size("w")), "list_length_mismatch")
        .when((F.col("vk") == "value") & ~_same(F.to_json("v"), F.to_json("w")), "value_mismatch")
    )
    long = F.col("type") == "list_length_mismatch"
    members = F.expr(
        "CASE WHEN vo IS NOT NULL AND wo IS NOT NULL THEN transform(map_entries(vo), e -> named_struct('path', concat(path, if(path = '', '', '.'), e.key), 'v', e.value, "
        "  'w', try_element_at(wo, e.key), 'has', map_contains_key(wo, e.key))) "
        "WHEN vl IS NOT NULL AND wl IS NOT NULL THEN transform(slice(vl, 1, least(size(vl), size(wl))), (x, i) -> named_struct('path', concat(path, '[', i, ']'), 'v', x, 'w', wl[i], 'has', true)) "
        "WHEN vl IS NOT NULL AND wo IS NOT NULL THEN transform(vl, (x, i) -> named_struct('path', concat(path, '[', i, ']'), 'v', x, 'w', CAST(NULL AS VARIANT), 'has', false)) END"
    )
    done = []

    def differing(opened: DataFrame) -> DataFrame:
        """Notes what differs on this level; gives the members of the next that do not read the same on both sides.

        Numbers that read differently are compared when they are reached.
        """
        typed = opened.withColumn("type", kind).where(F.col("type").isNotNull())
        done.append(typed.select(
            key, "path", "type", F.when(long, size("v").cast("string")).otherwise(F.to_json("v")).alias("local"), F.when(long, size("w").cast("string")).otherwise(F.to_json("w")).alias("remote")
        ))
        inner = opened.where(F.col("has") & (F.col("vk") != "value")).select(key, F.explode(members).alias("m")).select(key, "m.*")
        return inner.where(~F.col("has") | ~F.to_json("v").eqNullSafe(F.to_json("w")))

    while True:
        below = differing(cut(_opened(level)))
        level = differing(_opened(below))  # two levels a round
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)


def drift_status(local: DataFrame, remote: DataFrame, key: str = "asset", body: str = "body") -> DataFrame:
    """One row per declared document: ``in_sync``, ``drifted`` or ``not_found``."""
    counts = drift(local, remote, key, body).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    live = remote.select(key).distinct().withColumn("_live", F.lit(True))
    return (
        local.select(key)
        .join(live, key, "left")
        .join(counts, key, "left")
        .select(
            key,
            F.coalesce("_n", F.lit(0)).alias("diff_count"),
            F.when(F.col("_live").isNull(), "not_found").when(F.col("_n") > 0, "drifted").otherwise("in_sync").alias("status"),
        )
    )


def overall(status: DataFrame) -> DataFrame:
    """The worst state over all documents."""

    def count(state: str) -> Column:
        return F.count(F.when(F.col("status") == state, 1))

    return status.agg(count("in_sync").alias("in_sync"), count("drifted").alias("drifted"), count("not_found").alias("not_found")).withColumn(
        "overall_status", F.when(F.col("drifted") > 0, "drifted").when(F.col("not_found") > 0, "incomplete").otherwise("in_sync")
    )
