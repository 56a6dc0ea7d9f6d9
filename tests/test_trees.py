"""Euler tours and places inside large groups, against plain loops."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.ordering import numbered, sliced
from spanloom.operators.tour import arcs, tour
from spanloom.plans import queries, replay

EDGES = "scope string, span_id string, parent_id string, place int, at bigint, w bigint"


def brute(rows):
    out = []
    for scope in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == scope}
        children = {}
        for r in mine.values():
            children.setdefault(r[2] if r[2] in mine and r[2] != "" else None, []).append(r)
        for c in children.values():
            c.sort(key=lambda r: ((r[4] is not None, r[4] or 0), r[3]))
        found = []

        def walk(node, root, depth):
            at = len(found)
            found.append(None)
            total = node[5] or 0
            for child in children.get(node[1], []):
                total += walk(child, root, depth + 1)
            found[at] = (scope, node[1], root, depth, at, len(found) - 1, total)
            return total

        for r in children.get(None, []):
            walk(r, r[1], 0)
        out += found
    return sorted(out)


def forests(seed):
    rng = random.Random(seed)
    rows = []
    for s in range(6):
        n = rng.randint(1, 30)
        for k in range(n):
            parent = rng.choice([None, "", "gone", *[f"n{j}" for j in range(k)]]) if k else None
            rows.append((f"s{s}", f"n{k}", parent, rng.randint(0, 5) * 100 + k, rng.choice([None, 0, 1, 2]), rng.choice([None, 1, 5])))
        rows += [(f"s{s}", "c1", "c2", 900, 0, 1), (f"s{s}", "c2", "c1", 901, 0, 1), (f"s{s}", "own", "own", 902, 0, 1), (f"s{s}", "below", "c1", 903, 0, 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tour_of_random_forests(spark, seed):
    rows = forests(seed)
    found = tour(spark.createDataFrame(rows, EDGES).repartition(4), "scope", at="at", weights=["w"])
    assert sorted(map(tuple, found.select("scope", "span_id", "root", "depth", "pre", "last", "w").collect())) == brute(rows)


def test_tour_of_one_scope_without_a_time(spark):
    rows = [("s", "a", None, 2, None, 1), ("s", "b", None, 1, None, 2), ("s", "c", "a", 1, None, None)]
    found = tour(spark.createDataFrame(rows, EDGES), "scope", weights=["w"])
    assert {r.span_id: (r.pre, r.last, r.depth, r.w) for r in found.collect()} == {"b": (0, 0, 0, 2), "a": (1, 2, 0, 1), "c": (2, 2, 1, 0)}
    assert tour(spark.createDataFrame([], EDGES), "scope").count() == 0


def test_a_chain_and_a_star_keep_rows_narrow(spark):
    n = 20000
    chain = spark.range(n).selectExpr("'c' AS scope", "cast(id AS string) AS span_id", "if(id > 0, cast(id - 1 AS string), null) AS parent_id", "cast(id AS int) AS place", "id AS at", "1L AS w")
    star = spark.range(n).selectExpr("'s' AS scope", "cast(id AS string) AS span_id", "if(id > 0, '0', null) AS parent_id", "cast(id AS int) AS place", "id AS at", "1L AS w")
    found = tour(chain.unionByName(star), "scope", at="at", weights=["w"])
    number = F.col("span_id").cast("bigint")
    good = found.where((F.col("pre") == number) & F.when(F.col("scope") == "c", (F.col("depth") == number) & (F.col("last") == n - 1) & (F.col("w") == n - number)).otherwise(
        (F.col("depth") == (number > 0).cast("int")) & (F.col("last") == F.when(number == 0, n - 1).otherwise(number)) & (F.col("w") == F.when(number == 0, n).otherwise(1))
    ))
    assert good.count() == 2 * n
    assert not any(f.dataType.typeName() == "array" for f in found.schema.fields)


def test_toured_sums_count_repeated_rows(spark):
    ts = datetime.datetime(2024, 1, 1)
    rows = [("t", "a", None, ts, "success", 1.5), ("t", "b", "a", ts, "success", 2.0), ("t", "b", "a", ts + datetime.timedelta(1), "failure", 3.0), ("t", None, None, ts, "failure", None)]
    found = replay.toured(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, ts timestamp, event_outcome string, latency_ms double"))
    got = {r.span_id[:5]: (r.pre, r.last, r.events, r.failures, r.latency) for r in found.collect()}
    assert got["a"][2:] == (3, 1, decimal.Decimal("4.5")) and got["b"][2:] == (2, 1, 3) and got["_evt_"][2:] == (1, 1, 0)


def test_leaves_have_one_arc(spark):
    rows = [("s", "a", None, 1, None, 2), ("s", "b", "a", 2, None, 3), ("s", "c", "a", 3, None, None), ("s", "d", None, 4, None, 7)]
    nodes = spark.createDataFrame([(k, r[0], {"a": 0}.get(r[2]), r[3], r[5]) for k, r in enumerate(rows)], "_id bigint, _scope string, _up bigint, _place int, w bigint")
    walk = {r.arc: (r.next, r.down, r.up, r.root, r.w) for r in arcs(nodes, "_scope", ["w"]).collect()}
    assert walk == {0: (2, 1, 0, None, 2), 2: (4, 1, 1, None, 3), 4: (1, 1, 1, None, 0), 1: (6, 0, 1, 0, 0), 6: (None, 1, 1, 3, 7)}
    found = tour(spark.createDataFrame(rows, EDGES), "scope", weights=["w"])
    assert sorted(map(tuple, found.select("scope", "span_id", "root", "depth", "pre", "last", "w").collect())) == brute(rows)


PLACED = "who string, ts timestamp, tie int"


def test_places_in_hot_and_small_groups(spark):
    rng = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", None, f"g{rng.randint(0, 40)}"]), rng.choice([None, day, day + datetime.timedelta(seconds=rng.randint(0, 900))]), k) for k in range(3000)]
    found = numbered(spark.createDataFrame(rows, PLACED).repartition(5), ["who"], "ts", [F.col("tie")])
    want = {}
    for who in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == who), key=lambda r: (r[1] is not None, r[1] or day, r[2]))
        want |= {r[2]: k + 1 for k, r in enumerate(mine)}
    assert {r.tie: r.seq for r in found.collect()} == want
    assert numbered(spark.createDataFrame([], PLACED), ["who"], "ts").count() == 0


def test_a_hot_group_is_many_tasks(spark):
    """A group with nearly all rows: no task of the numbering holds more than twice the median."""
    rows = spark.range(200000).selectExpr("if(id % 50 = 0, concat('g', id % 97), 'hot') AS who", "timestamp_seconds(id) AS ts", "id AS tie")
    sizes = sorted(r["count"] for r in sliced(rows, "ts").groupBy("who", "_slice").count().where("who = 'hot'").collect())
    assert len(sizes) >= 30 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_timelines_of_a_skewed_table_keep_their_order(spark):
    events = spark.range(3000).selectExpr(
        "timestamp_seconds(id div 2) AS ts", "concat('s', id) AS span_id", "if(id % 3 > 0, 'hot', concat('a', id % 10)) AS agent_id", "concat('t', id div 100) AS trace_id",
        *[f"cast(null AS string) AS {c}" for c in ("event_dataset", "event_action", "event_outcome", "tool_name", "request_model", "turn_id", "component_type", "semantic_kind", "error_type", "message")],
        "1.0D AS latency_ms", "1L AS input_tokens", "1L AS output_tokens", "0.0D AS cost",
    )
    hot = [r.span_id for r in queries.timelines(events).where("run_id = 'hot'").orderBy("seq").collect()]
    want = sorted((f"s{i}" for i in range(3000) if i % 3), key=lambda s: (int(s[1:]) // 2, s))
    assert hot == want
    assert queries.timelines(events, size=2).where("run_id = 'hot'").count() == 2
