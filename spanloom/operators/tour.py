"""Pre-order places of a forest by an Euler tour and list ranking.

Every node has two arcs, into it and out of it, a leaf one for both; each arc knows the next one of a walk around the trees of its scope.
Doubling the pointers sums, for every arc, what lies from it to the end of the walk: arcs down and up, any weights, and the next root left. From
that follow the place of a node, the end of its subtree, its depth, its root and sums over its subtree. A row stays as
narrow as it was however deep a tree is, and a chain of n nodes takes log2(2n) rounds. The rounds replace each other in the
shared folder. Arcs of a cycle reach no end and fall out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds, cut
from .ordering import numbered


def siblings(nodes: DataFrame, scope: str, place: str, at: str | None) -> DataFrame:
    """Nodes with their number among the children of their parent; the roots of a scope are siblings."""
    if at is None:
        return nodes.withColumn("_n", F.row_number().over(Window.partitionBy(scope, "_up").orderBy(place)).cast("bigint"))
    return numbered(nodes, [scope, "_up"], at, [F.col(place)], "_n")


def arcs(nodes: DataFrame, scope: str, weights: Sequence[str], place: str = "_place", at: str | None = None) -> DataFrame:
    """``arc, next, down, up, root`` and the weights; a leaf has the arc into it alone, which leads on as that out of it would.

    ``nodes`` has ``_id`` (unique), ``_up`` (id of the parent or null) and is stored."""
    ordered = cut(siblings(nodes, scope, place, at).select("_id", "_up", F.col(scope).alias("_s"), "_n", *weights))
    first = ordered.where("_n = 1 AND _up IS NOT NULL").select(F.col("_up").alias("_p"), F.col("_id").alias("_child"))
    after = ordered.select(F.col("_s").alias("_as"), F.col("_up").alias("_au"), (F.col("_n") - 1).alias("_an"), F.col("_id").alias("_next"))
    same = F.col("_s").eqNullSafe(F.col("_as")) & F.col("_up").eqNullSafe(F.col("_au")) & (F.col("_n") == F.col("_an"))
    known = ordered.join(first, F.col("_id") == F.col("_p"), "left").join(after, same, "left")
    leaf, past = F.col("_child").isNull(), F.coalesce(F.col("_next") * 2, F.col("_up") * 2 + 1)
    root = F.when(F.col("_up").isNull(), F.col("_id"))
    into = F.struct(
        (F.col("_id") * 2).alias("arc"), F.when(leaf, past).otherwise(F.col("_child") * 2).alias("next"), F.lit(1).cast("bigint").alias("down"), leaf.cast("bigint").alias("up"),
        F.when(leaf, root).alias("root"), *[F.coalesce(w, F.lit(0)).cast(ordered.schema[w].dataType).alias(w) for w in weights],
    )
    out = F.struct(
        (F.col("_id") * 2 + 1).alias("arc"), past.alias("next"), F.lit(0).cast("bigint").alias("down"), F.lit(1).cast("bigint").alias("up"),
        root.alias("root"), *[F.lit(0).cast(ordered.schema[w].dataType).alias(w) for w in weights],
    )
    return known.select(F.explode(F.when(leaf, F.array(into)).otherwise(F.array(into, out))).alias("a")).select("a.*")


def ranked(walk: DataFrame, sums: Sequence[str]) -> DataFrame:
    """For every arc that reaches the end of its walk: its sums from there to the end, and the first root that is left."""
    rounds = Rounds(walk.sparkSession, "tour")
    state = rounds.keep(walk)
    rest = state.where("next IS NOT NULL").count()
    while rest:
        ahead = state.select(F.col("arc").alias("_arc"), F.col("next").alias("_next"), F.col("root").alias("_root"), *[F.col(s).alias(f"_{s}") for s in sums])
        moving = state.where("next IS NOT NULL").join(ahead, F.col("next") == F.col("_arc"))
        added = [(F.col(s) + F.col(f"_{s}")).cast(state.schema[s].dataType).alias(s) for s in sums]
        moved = moving.select("arc", F.col("_next").alias("next"), F.coalesce("root", "_root").alias("root"), *added)
        state = rounds.keep(state.where("next IS NULL").unionByName(moved))
        left = state.where("next IS NOT NULL").count()
        if left == rest:  # nobody arrived: what is left runs in circles
            break
        rest = left
    return state.where("next IS NULL").drop("next")


def tour(
    edges: DataFrame, scope: str, node: str = "span_id", parent: str = "parent_id", place: str = "place", at: str | None = None, weights: Sequence[str] = ()
) -> DataFrame:
    """``scope, node, root, depth, pre, last`` of every reachable node, and the sum of each of ``weights`` over its subtree (nulls are 0).

    ``pre`` numbers the nodes of a scope from 0 in pre-order, trees and children by their place; the subtree of a node has the places
    ``pre`` to ``last``. ``(scope, node)`` must be unique; a node whose parent is not in the scope is a root. ``at`` names a number or time
    that comes first in the order of places: with it the children of one node may be any number (``ordering.numbered``).
    """
    columns = [F.col(scope).alias("_scope"), F.col(node).alias("_node"), F.nullif(F.col(parent), F.lit("")).alias("_parent"), F.col(place).alias("_place")]
    columns += [F.col(at).alias("_at")] if at else []
    own = cut(edges.select(*columns, *[F.col(w) for w in weights]).withColumn("_id", F.monotonically_increasing_id()))
    ids = own.select(F.col("_scope").alias("_ps"), F.col("_node").alias("_pn"), F.col("_id").alias("_up"))
    linked = own.join(ids, (F.col("_scope") == F.col("_ps")) & (F.col("_parent") == F.col("_pn")), "left").drop("_ps", "_pn", "_parent")
    walk = arcs(linked, "_scope", weights, "_place", "_at" if at else None)
    found = ranked(walk, ["down", "up", *weights])
    into = found.where("arc % 2 = 0").withColumn("_id", F.expr("arc div 2"))
    out = found.where("arc % 2 = 1").select(F.expr("arc div 2").alias("_o"), F.col("down").alias("_down"), *[F.col(w).alias(f"_{w}") for w in weights])
    mine = own.select("_id", "_scope", "_node", *[F.coalesce(w, F.lit(0)).cast(edges.schema[w].dataType).alias(f"_own_{w}") for w in weights])
    both = cut(into.join(out, F.col("_id") == F.col("_o"), "left").join(mine, "_id"))
    whole = both.groupBy(F.col("_scope").alias("_ws")).agg(F.max("down").alias("_whole"))
    roots = own.select(F.col("_id").alias("root"), F.col("_node").alias("_root"))
    placed = both.join(whole, F.col("_scope") == F.col("_ws")).join(roots, "root")
    leaf = F.col("_o").isNull()
    sums = [F.when(leaf, F.col(f"_own_{w}")).otherwise(F.col(w) - F.col(f"_{w}")).cast(edges.schema[w].dataType).alias(w) for w in weights]
    pre = F.col("_whole") - F.col("down")
    return placed.select(
        F.col("_scope").alias(scope), F.col("_node").alias(node), F.col("_root").alias("root"), (F.col("up") - F.col("down")).cast("int").alias("depth"),
        pre.alias("pre"), F.when(leaf, pre).otherwise(pre + F.col("down") - F.col("_down") - 1).alias("last"), *sums,
    )
