"""Span forest of every scope at once, by pointer doubling.

Each node starts with a pointer to its parent and the path of that one step. A
round replaces the pointer by the pointer of the node pointed at and joins the two
paths, so a chain of depth d is finished after log2(d) rounds instead of d. Only
nodes that have not reached a root take part in the next round; the rounds are cut
with checkpoints. Nodes on a cycle reach no root and fall out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def last_per_span(rows: DataFrame, scope: str, order: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """One node per (scope, span): the last row's content, the first row's place."""
    rank = F.struct(*order)
    grouped = rows.groupBy(scope, "span_id").agg(
        F.max_by(F.struct(*payload), rank).alias("_p"), F.min(rank).alias("place"), F.count(F.lit(1)).alias("events")
    )
    return grouped.select(scope, "span_id", "place", "events", "_p.*")


def forest(edges: DataFrame, scope: str, node: str = "span_id", parent: str = "parent_id", place: str = "place") -> DataFrame:
    """``scope, node, root, depth, path`` of every reachable node; path lists the places from the root down.

    ``(scope, node)`` must be unique. A node whose parent is not in the scope is a
    root, also when it names one. Ordering by ``scope, path`` lists each tree in
    pre-order, children by their place. Hand in the narrow edge columns only; wide
    rows are joined to the result once.
    """
    edges = cut(edges.select(scope, node, F.nullif(F.col(parent), F.lit("")).alias("_parent"), F.col(place).alias("_place")))
    known = edges.select(F.col(scope).alias("_s"), F.col(node).alias("_known"))
    linked = edges.join(known, (F.col(scope) == F.col("_s")) & (F.col("_parent") == F.col("_known")), "left").select(
        scope, node, F.col("_known").alias("_up"), F.array("_place").alias("path")
    )
    state = cut(
        linked.select(
            scope, node, "path", F.col("_up").isNull().alias("done"), F.coalesce("_up", F.col(node)).alias("_up"),
        )
    )
    rest = state.where(~F.col("done")).count()
    while rest:
        target = state.select(
            F.col(scope).alias("_s"), F.col(node).alias("_t"), F.col("_up").alias("_t_up"), F.col("path").alias("_t_path"), F.col("done").alias("_t_done")
        )
        moving = state.where(~F.col("done"))
        moved = moving.join(target, (F.col(scope) == F.col("_s")) & (F.col("_up") == F.col("_t"))).select(
            scope, node, F.concat("_t_path", "path").alias("path"), F.col("_t_done").alias("done"), F.col("_t_up").alias("_up")
        )
        state = cut(state.where(F.col("done")).unionByName(moved))
        left = state.where(~F.col("done")).count()
        if left == rest:  # nobody arrived: what is left runs in circles
            break
        rest = left
    return state.where(F.col("done")).select(
        scope, node, F.col("_up").alias("root"), (F.size("path") - 1).alias("depth"), "path"
    )
