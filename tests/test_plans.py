"""Plans on hand-made tables: the cases an operator must get right whatever the data."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.timeframe import at_least, at_most, instant, split_range, within
from spanloom.operators import filters, pricing
from spanloom.operators.drift import drift, drift_status, overall
from spanloom.operators.facets import best, dominant, facet_counts, ranked_lists, terms
from spanloom.operators.forest import forest
from spanloom.operators.histogram import ordered_dimensions
from spanloom.operators.quantiles import quantiles
from spanloom.plans import alerts, cost, discovery, evaluate, health, panels, queries, replay, report
from spanloom.schema import CARRIED, FIELDS
from spanloom.sources import prices

KINDS = {n: k for n, k, _ in FIELDS + CARRIED}
BASE = datetime.datetime(2024, 1, 31)


def events_of(spark, rows):
    """Event rows from dicts; ``ago`` is minutes before the reference time."""
    used = ["ts", *sorted({k for r in rows for k in r if k != "ago"} | {
        "event_outcome", "event_dataset", "tool_name", "request_model", "conversation_id", "turn_id", "component_type", "error_type",
        "input_tokens", "output_tokens", "retry_count", "latency_ms", "event_duration", "cost", "span_id", "guardrail_action",
    })]
    data = [tuple((BASE - datetime.timedelta(minutes=r.get("ago", 1))) if n == "ts" else r.get(n) for n in used) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} {'timestamp_ntz' if n == 'ts' else KINDS[n]}" for n in used))


# ---------------------------------------------------------------- time
def test_time_anchors(spark):
    one = spark.range(1)
    value = one.select(instant("now-1d+2h", "2024-01-31 00:00:00").alias("t")).first().t
    assert value == datetime.datetime(2024, 1, 30, 2)
    assert one.select(instant("now-3y", "2024-01-31 00:00:00").alias("t")).first().t.year == 2021
    assert split_range("a / b", "x", "y") == ("a", "b") and split_range("a", "x", "y") == ("a", "y") and split_range("", "x", "y") == ("x", "y")
    with pytest.raises(ValueError):
        instant("now-15q")


def test_boundary_rows_are_in_both_windows(spark):
    rows = events_of(spark, [{"ago": 15}, {"ago": 14}, {"ago": 16}])
    now = "2024-01-31 00:00:00"
    assert rows.where(at_least(rows, "now-15m", now)).count() == 2
    assert rows.where(within(rows, "now-24h/now-15m", now)).count() == 2
    assert rows.where(at_most(rows, "now-16m", now)).count() == 1


def test_time_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    events_of(spark, [{"ago": i} for i in range(10)]).withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(at_least(df, "now-5m", "2024-01-31 00:00:00")).select("ts")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(ts" in plan


# ---------------------------------------------------------------- quantiles
def exact(values, p):
    values = sorted(values)
    spot = p * (len(values) - 1)
    low = int(spot)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (spot - low)


def test_quantiles_against_brute_force(spark):
    random.seed(3)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in [random.lognormvariate(5, 3) * random.choice((1, 1, -1)) for _ in range(random.randint(1, 400))]]
    rows += [("same", 7.0)] * 50 + [("one", 3.5)] + [("none", None)]
    out = quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()
    assert {r.g for r in out} == {"a", "b", None, "same", "one"}
    for r in out:
        values = [v for g, v in rows if g == r.g]
        for name, p in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            assert r[name] == pytest.approx(exact(values, p), rel=1e-12)


def test_quantiles_join_path_for_many_groups(spark, monkeypatch):
    from spanloom import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = [(i % 7, i) for i in range(500)]
    out = quantiles(spark.createDataFrame(rows, "g int, v bigint"), ["g"], "v", {"p": 0.9}).collect()
    assert {r.g: r.p for r in out} == {g: pytest.approx(exact([v for k, v in rows if k == g], 0.9)) for g in range(7)}


def test_quantiles_of_one_hot_group_stay_split(spark):
    """A hot group shuffles its buckets, never its rows, to one task."""
    rows = spark.range(100000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 1000)) AS g", "id AS v")
    plan = quantiles(rows, [], "v", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan
    assert quantiles(rows, [], "v", {"p": 0.5}).first().p == pytest.approx(49999.5)


def test_measures_ride_along_with_quantiles(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", None, 3), ("b", None, 4)], "g string, v double, n int")
    for approx in (False, True):
        out = quantiles(rows, ["g"], "v", {"p": 0.5}, approx, measures={"rows": F.count(F.lit(1)), "total": F.sum("n")}).collect()
        assert {r.g: (r.rows, r.total, r.p) for r in out} == {"a": (2, 5, 1.0), "b": (1, 4, None)}


# ---------------------------------------------------------------- facets
def test_terms_order_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "k string")
    assert [(r.k, r["count"]) for r in terms(df, "k", 2).collect()] == [("c", 2), ("a", 1)]


def test_ranked_lists_leave_out_zero_failures(spark):
    df = spark.createDataFrame([("t1", "failure"), ("t2", "success"), ("t2", "success")], "tool string, event_outcome string")
    counts = facet_counts(df, {"tool": "tool"}, failures=F.count(F.when(F.col("event_outcome") == "failure", 1)))
    out = ranked_lists(counts, {"all": ("tool", "count"), "bad": ("tool", "failures")}, 5, positive=("bad",)).collect()
    assert sorted((r.list, r.rank, r.key, r["count"]) for r in out) == [("all", 1, "t2", 2), ("all", 2, "t1", 1), ("bad", 1, "t1", 1)]


def test_dominant_takes_the_smaller_key_on_ties(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 1), (2, None, 9), (2, "z", 1)], "g int, k string, count int")
    assert {r.g: r.k for r in dominant(df, ["g"], "k").collect()} == {1: "a", 2: "z"}


def test_top_lists_are_cut_in_the_map_tasks(spark):
    plan = best(spark.range(1000).selectExpr("id % 3 AS g", "id AS k", "id AS n"), "k", "n", 5, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# ---------------------------------------------------------------- queries, report, panels
def test_query_templates(spark):
    rows = events_of(
        spark,
        [
            {"ago": 5, "trace_id": "t", "span_id": "s1", "agent_id": "r", "tool_name": "x", "latency_ms": 10.0, "conversation_id": "c", "event_outcome": "failure"},
            {"ago": 9, "trace_id": "t", "span_id": "s0", "agent_id": "q", "tool_name": "x", "latency_ms": 30.0, "conversation_id": "c", "event_outcome": "success"},
            {"ago": 7, "trace_id": "u", "span_id": "s2", "agent_id": "t", "event_outcome": "success", "event_dataset": "internal.sanity_check"},
            {"ago": 6, "trace_id": "u", "span_id": "s3", "agent_id": "t", "event_outcome": "failure", "event_dataset": "internal.alert_check"},
        ],
    )
    extra = {"event_action": "string", "service_name": "string", "message": "string", "semantic_kind": "string"}
    rows = rows.withColumns({n: F.lit(None).cast(k) for n, k in extra.items()})
    now = "2024-01-31 00:00:00"
    assert [r.span_id for r in queries.trace(rows, "t").collect()] == ["s0", "s1"]
    assert [r.span_id for r in queries.timeline(rows, "t").collect()] == ["s0", "s3", "s1"]
    tool = queries.tools(rows, as_of=now).collect()
    assert [(r.tool_name, r.calls, r.errors, r.avg_latency_ms, r.p95_latency_ms) for r in tool] == [("x", 2, 1, 20.0, pytest.approx(29.0))]
    assert queries.errors(rows, as_of=now).count() == 2
    assert queries.sessions(rows, as_of=now).first().events == 2


def test_report_of_an_empty_window_is_zero(spark):
    row = report.scalars(events_of(spark, [{"ago": 60 * 48}]), as_of="2024-01-31 00:00:00").first()
    assert (row.documents, row.success_rate, row.tool_error_rate, row.p95_latency_ms, row.cost_total) == (0, 0.0, 0.0, 0.0, 0.0)


def test_report_numbers(spark):
    rows = [{"event_outcome": "failure" if i < 5 else "success", "tool_name": "t" if i % 2 else None, "event_duration": 500_000_000, "retry_count": 1} for i in range(100)]
    row = report.scalars(events_of(spark, rows), as_of="2024-01-31 00:00:00").first()
    assert (row.documents, row.success_rate, row.tool_error_rate, row.p50_latency_ms, row.retry_total) == (100, 0.95, 0.04, 500.0, 100)


def test_panel_specs(spark):
    assert panels.load_specs('{"panels": [{"id": "a"}]}') == [{"id": "a"}] and panels.load_specs('[{"id": "b"}]') == [{"id": "b"}]
    rows = events_of(spark, [{"tool_name": "x", "retry_count": 2}, {"tool_name": "x", "retry_count": 3}])
    assert panels.custom(rows, {"aggregation": "average"}) is None
    assert panels.custom(rows, {"aggregation": "sum", "field": "retry_count"}).first()["sum"] == 5
    assert set(panels.dashboard(rows.withColumns({c: F.lit(None).cast(KINDS[c]) for c in KINDS if c not in rows.columns}), extensions=[{"id": "mine"}])) >= {"mine", "latency", "trace_timeline"}


# ---------------------------------------------------------------- cost
def test_price_matching(spark):
    models = ["gpt-4o-mini", "GPT-4o-2024 ", "gpt-4-0613", "o1-preview", "house", "claude-3-5-sonnet-x", None]
    df = spark.createDataFrame([(m,) for m in models], "request_model string")
    want = {"gpt-4o-mini": "gpt-4o-mini", "GPT-4o-2024 ": "gpt-4o", "gpt-4-0613": "gpt-4", "o1-preview": "o1", "house": None, "claude-3-5-sonnet-x": "claude-3-5-sonnet"}
    table = prices.prices()
    inline = {r.request_model: r._price.pattern if r._price else None for r in pricing.with_price(df, table).collect() if r.request_model}
    joined = {r.request_model: r._price.pattern if r._price else None for r in pricing.with_price(df, prices.price_frame(spark, table)).collect() if r.request_model}
    assert inline == want and joined == want


def test_call_cost_and_overrides(spark):
    df = spark.createDataFrame([("gpt-4o-mini", 1_000_000, 500_000), ("House-X", 1_000_000, None)], "request_model string, input_tokens bigint, output_tokens bigint")
    table = prices.prices('{"HOUSE": {"input": 2, "output": 4}, "gpt-4o-mini": [0.3, 0.6], "bad": 5}')
    out = pricing.with_price(df, table).withColumn("c", pricing.call_cost()).collect()
    assert [r.c for r in out] == [0.6, 2.0] and "bad" not in table
    plain = pricing.with_price(df, prices.prices()).withColumn("c", pricing.call_cost()).collect()
    assert [r.c for r in plain] == [0.45, None]


def test_backfill_touches_only_rows_without_cost(spark):
    rows = events_of(
        spark,
        [{"request_model": "gpt-4o", "input_tokens": 1000, "cost": 9.0}, {"request_model": "gpt-4o", "input_tokens": 1000}, {"request_model": "house", "input_tokens": 5}, {"request_model": "gpt-4o", "input_tokens": 1000, "ago": 9999}],
    )
    now = "2024-01-31 00:00:00"
    assert sorted((r.cost is None, r.cost) for r in cost.backfill(rows, as_of=now).collect()) == [(False, 0.0025), (False, 9.0), (True, None), (True, None)]
    assert [r.model for r in cost.unpriced_models(rows, as_of=now).collect()] == ["house"]


# ---------------------------------------------------------------- alerts
NOW = "2024-01-31 00:00:00"


def window_rows(errors=0, total=100, ms=100, tokens=0, retries=0, turn_ms=100.0, sessions=("s1",)):
    out = []
    for i in range(total):
        out.append(
            {
                "ago": 1, "event_outcome": "failure" if i < errors else "success", "error_type": "TimeoutError" if i < errors else None,
                "event_duration": ms * 1_000_000, "input_tokens": tokens // total, "output_tokens": 0, "retry_count": retries if i == 0 else 0,
                "tool_name": "web_search", "request_model": "m", "conversation_id": sessions[i % len(sessions)], "turn_id": "turn-1", "component_type": "tool", "latency_ms": turn_ms,
            }
        )
    return out


def baseline_rows(errors=2, total=100, tokens=1000):
    return [{"ago": 60, "event_outcome": "failure" if i < errors else "success", "event_duration": 1_000_000_000, "input_tokens": tokens // total, "retry_count": 1 if i == 0 else 0} for i in range(total)]


def found(spark, **window):
    out = alerts.alerts(events_of(spark, window_rows(**window) + baseline_rows()), as_of=NOW).collect()
    return {r.alert_type: r for r in out}


def test_quiet_window_gives_no_alert(spark):
    assert found(spark, errors=5, sessions=tuple(f"s{i}" for i in range(20))) == {}


def test_error_spike_and_session_hotspot(spark):
    out = found(spark, errors=20, sessions=("s1", "s1", "s1", "s2"))
    spike, hot = out["error_rate_spike"], out["session_failure_hotspot"]
    assert (spike.error_rate, spike.baseline_rate, spike.severity, spike.primary_type, spike.primary_tool) == (0.2, 0.02, "warning", "TimeoutError", "web_search")
    assert "dependency" in spike.root_cause
    assert (hot.primary_session, hot.session_failures, hot.concentration, hot.severity) == ("s1", 15, 0.75, "critical")
    # 0.3 + min(.35, 9/5) + 3 signal lists
    assert spike.confidence == 0.74
    assert hot.confidence == 0.66


def test_token_anomaly_names_the_token_session(spark):
    rows = window_rows(tokens=10_000, sessions=("busy", "busy", "retrying")) + baseline_rows()
    out = {r.alert_type: r for r in alerts.alerts(events_of(spark, rows), as_of=NOW).collect()}["token_consumption_anomaly"]
    assert (out.ratio, out.severity, out.primary_session, out.primary_session_source) == (10.0, "critical", "busy", "token")


def test_latency_and_long_turn(spark):
    out = found(spark, ms=12_000, turn_ms=4200.0)
    assert out["latency_degradation"].severity == "critical" and out["latency_degradation"].p95_ms == 12000.0
    assert out["latency_degradation"].top_latency_tools[0].value == 12000.0
    assert (out["long_turn_hotspot"].severity, out["long_turn_hotspot"].turn_latency_ms, out["long_turn_hotspot"].primary_session) == ("warning", 4200.0, "s1")


def test_retry_storm(spark):
    out = found(spark, retries=12)["retry_storm"]
    assert (out.severity, out.total_retries, out.baseline_multiplier) == ("critical", 12, 12.0)


def test_rules_and_overrides(spark):
    rules = alerts.load_rules('{"error_threshold": 3, "time_range": "now-30m", "webhook_templates": {}}')
    assert rules.error_threshold == 3 and rules.time_range == "now-30m" and rules.token_threshold_multiplier == 3.0
    rows = events_of(spark, window_rows(errors=5, sessions=tuple(f"s{i}" for i in range(20))))
    strict = spark.createDataFrame([("all", 4, None, None)], "scope string, error_threshold int, p95_latency_threshold_ms double, token_threshold_multiplier double")
    assert [r.alert_type for r in alerts.alerts(rows, as_of=NOW, overrides=strict).collect()] == ["error_rate_spike"]


def alert_rows(spark, *rows):
    """Fired alerts with only entities, as (type, severity, confidence, {list: keys})."""
    names = list(alerts.EVIDENCE_LISTS)
    order = [k["alert_type"] for k in alerts._chosen()]
    data = []
    for kind, severity, confidence, lists in rows:
        data.append(("all", order.index(kind), kind, True, severity, confidence, f"about {kind}", *[[(i + 1, k, 1, 1.0) for i, k in enumerate(lists.get(n, []))] if n != "top_turns" else [(1, k, 1, 1.0, 0, s, c) for k, s, c in lists.get(n, [])] for n in names]))
    ddl = "scope string, ord int, alert_type string, fired boolean, severity string, confidence double, phenomenon string, " + ", ".join(f"{n} {alerts.EVIDENCE_LISTS[n]}" for n in names)
    return spark.createDataFrame(data, ddl)


def chains_of(spark, *rows):
    return [(r.narrative, r.confidence, [(e.kind, e.key) for e in r.shared_entities]) for r in alerts.chains(alert_rows(spark, *rows)).collect()]


def test_chains(spark):
    spike = ("error_rate_spike", "warning", 0.5, {"top_error_tools": ["search"]})
    storm = ("retry_storm", "critical", 0.8, {"top_retry_tools": ["search"], "top_retry_sessions": ["s1"]})
    turn = ("long_turn_hotspot", "warning", 0.4, {"top_turns": [("t1", "s1", "tool")]})
    lone = ("latency_degradation", "warning", 0.9, {"top_latency_tools": ["other"]})
    assert chains_of(spark, spike) == []
    assert chains_of(spark, spike, lone) == []
    assert chains_of(spark, spike, storm) == [("retry_storm -> error_rate_spike", 0.8, [("tool", "search")])]
    # linked only through the storm, so nothing is shared by all three
    assert chains_of(spark, spike, storm, turn, lone) == [("retry_storm -> error_rate_spike -> long_turn_hotspot", 0.8, [])]


def test_unknown_and_blank_entities_do_not_link(spark):
    a = ("error_rate_spike", "warning", 0.5, {"top_error_tools": ["unknown", " "]})
    b = ("retry_storm", "warning", 0.5, {"top_retry_tools": ["unknown", ""]})
    assert chains_of(spark, a, b) == []


def test_quiet_scopes_get_an_ok_row(spark):
    scopes = spark.createDataFrame([("all",), ("service_name=b",)], "scope string")
    rows = alerts.alert_events(alert_rows(spark, ("retry_storm", "critical", 0.8, {"top_retry_sessions": ["s9"]})).withColumns({"root_cause": F.lit("x"), "recommendation": F.lit("y")}), scopes).collect()
    assert sorted((r.scope, r.event_action, r.event_outcome, r.conversation_id) for r in rows) == [
        ("all", "retry_storm", "failure", "s9"), ("service_name=b", "alert_check_ok", "success", None)
    ]


# ---------------------------------------------------------------- evaluators
def evaluate_rows(spark, rows, **options):
    return {r.evaluator: r for r in evaluate.run(events_of(spark, rows), as_of=NOW, **options).collect()}


def test_evaluators_pass_without_a_baseline(spark):
    out = evaluate_rows(spark, [{"tool_name": "a", "event_outcome": "success", "event_duration": 1, "input_tokens": 5}])
    assert {r.outcome for r in out.values()} == {"pass"} and {r.score for r in out.values()} == {1.0}


def test_regressions(spark):
    now = [{"event_outcome": "failure" if i < 3 else "success", "event_duration": 500_000_000, "tool_name": "a", "conversation_id": "c", "input_tokens": 30, "cost": 0.3, "guardrail_action": "block" if i < 5 else "pass"} for i in range(100)]
    before = [{"ago": 120, "event_outcome": "failure" if i < 2 else "success", "event_duration": 100_000_000, "tool_name": "abcd"[i % 4], "conversation_id": "c", "input_tokens": 10, "cost": 0.3} for i in range(100)]
    out = evaluate_rows(spark, now + before)
    assert (out["latency_regression"].outcome, out["latency_regression"].score) == ("fail", 0.2)
    assert (out["error_rate_regression"].outcome, out["error_rate_regression"].score) == ("pass", 0.97)
    assert (out["token_efficiency"].outcome, out["token_efficiency"].score) == ("fail", 0.8)
    assert (out["cost_regression"].outcome, out["cost_regression"].score) == ("pass", 1.0)
    assert (out["tool_coverage"].outcome, out["tool_coverage"].score) == ("fail", 0.25)
    assert "b, c, d" in out["tool_coverage"].detail
    assert (out["guardrail_block_rate"].outcome, out["guardrail_block_rate"].score) == ("pass", 0.95)
    total = evaluate.summary(evaluate.run(events_of(spark, now + before), as_of=NOW)).first()
    assert (total.overall_outcome, total.evaluator_count) == ("fail", 7)


def test_registry(spark, monkeypatch):
    monkeypatch.setitem(evaluate.EVALUATORS, "broken", lambda: 1 / 0)
    out = evaluate_rows(spark, [{}], evaluators=["broken", "no_such_rule", "tool_coverage"])
    assert set(out) == {"broken", "tool_coverage"} and (out["broken"].outcome, out["broken"].score) == ("fail", 0.0)


def test_judge_replies(spark):
    texts = ['{"score": 9, "rationale": "ok"}', "score: 3.5 of 10", "no digits", '{"rationale": "8"}', '{"score": "many 2"}', "", None]
    out = evaluate.judge_scores(spark.createDataFrame([(t,) for t in texts], "reply string")).collect()
    assert [(r.score, r.outcome) for r in out] == [(0.9, "pass"), (0.35, "fail"), (0.5, "degraded"), (0.5, "degraded"), (0.2, "fail"), (0.5, "degraded"), (0.5, "degraded")]


# ---------------------------------------------------------------- replay
def tree_of(spark, edges):
    df = spark.createDataFrame([("s", n, p, i) for i, (n, p) in enumerate(edges)], "scope string, span_id string, parent_id string, place int")
    return {r.span_id: (r.root, r.depth, list(r.path)) for r in forest(df, "scope").collect()}


def test_forest_of_deep_chains_roots_and_cycles(spark):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 40)]
    out = tree_of(spark, chain + [("lost", "absent"), ("x", "y"), ("y", "x"), ("self", "self"), ("z", "x"), ("kid", "lost"), ("blank", "")])
    assert out["n39"][:2] == ("n0", 39) and out["n39"][2] == list(range(40))
    assert out["lost"][:2] == ("lost", 0) and out["kid"][:2] == ("lost", 1) and out["blank"][:2] == ("blank", 0)
    assert not {"x", "y", "z", "self"} & set(out)


def test_forest_against_recursion(spark):
    random.seed(5)
    edges = [(f"n{i}", f"n{random.randint(0, i - 1)}" if i and random.random() > 0.1 else None) for i in range(200)]
    random.shuffle(edges)
    parent, place = dict(edges), {n: i for i, (n, _) in enumerate(edges)}

    def path(n):
        return (path(parent[n]) if parent[n] else []) + [place[n]]

    assert {n: p for n, (_, _, p) in tree_of(spark, edges).items()} == {n: path(n) for n in parent}


def test_replay_rows(spark):
    rows = events_of(
        spark,
        [
            {"ago": 9, "trace_id": "t", "span_id": "a", "event_action": "start", "event_outcome": "success", "latency_ms": 12.4},
            {"ago": 8, "trace_id": "t", "span_id": "b", "parent_id": "a", "event_action": "old"},
            {"ago": 7, "trace_id": "t", "span_id": "b", "parent_id": "a", "event_action": "new", "event_outcome": "failure", "reasoning_action": "delegate", "reasoning_rationale": "why", "message": "m" * 300},
            {"ago": 6, "trace_id": "t", "event_action": "no span", "event_duration": 2_000_000},
        ],
    )
    out = replay.in_order(replay.replay(rows)).collect()
    assert [(r.action, r.depth, r.events) for r in out] == [("start", 0, 1), ("new", 1, 2), ("no span", 0, 1)]
    assert len(out[1].message) == 300
    stats = replay.stats(rows).first()
    assert (stats.total_events, stats.root_count) == (4, 2)
    text = {r.span_id: r.text for r in replay.lines(replay.replay(rows)).collect()}
    assert text["a"].startswith("✓ [2024-01-30T23:51:00") and text["a"].endswith("start 12ms")
    assert text["b"].splitlines()[1:3] == ["    💭 decided=delegate", "    📝 why"]
    assert replay.replay_one(rows, trace_id="t").count() == 3
    with pytest.raises(ValueError):
        replay.replay_one(rows)


def test_every_replayed_trace_is_that_of_its_own_replay(spark):
    from catalog import projection, registry

    sf = "/root/testdata/sf0.001"
    rows = projection.events(spark, sf)
    every = registry.plans()["replay_every"](spark, sf).collect()
    assert len(every) == rows.where("trace_id IS NOT NULL").count() > 8
    one = replay.replay_one(rows, trace_id="trace-3").select("span_id", "outcome", "message").collect()
    assert [tuple(r)[1:] for r in every if r.scope == "trace-3"] == [tuple(r) for r in one]


# ---------------------------------------------------------------- health
def test_coverage_and_score(spark):
    rows = events_of(spark, [{"tool_name": "t", "conversation_id": "c", "turn_id": "u", "component_type": "tool"}, {"tool_name": "t"}])
    rows = rows.withColumns({n: F.lit(None).cast(KINDS[n]) for n in ("reasoning_action", "feedback_score")})
    fields = health.coverage(rows, as_of=NOW)
    got = {r.field: (r.doc_count, r.coverage) for r in fields.collect()}
    assert got["gen_ai.tool.name"] == (2, 1.0) and got["gen_ai.conversation.id"] == (1, 0.5) and got["error.type"] == (0, 0.0)
    score = health.coverage_score(fields).first()
    assert (score.score, score.status, score.tier2_missing, score.tier3_missing) == (0.62, "pass", 0, 5)
    silent = health.coverage_score(health.coverage(rows.where("tool_name = 'x'"), as_of=NOW)).first()
    assert silent.status == "warn"


@pytest.mark.parametrize(
    "checks, verdict",
    [
        ({"recent_data": "pass", "canary": "pass", "processes_and_ports": "pass"}, "healthy"),
        ({"recent_data": "pass", "canary": "skipped", "processes_and_ports": "pass", "instrumentation_coverage": "warn"}, "healthy"),
        ({"recent_data": "pass", "canary": "fail"}, "broken"),
        ({"recent_data": "unreachable", "canary": "fail"}, "unreachable"),
        ({"recent_data": "pass", "canary": "pass", "bridge": "up", "collector": "down", "processes_and_ports": "warn"}, "degraded_collector_path"),
        ({"recent_data": "pass", "canary": "pass", "bridge": "down", "collector": "down", "processes_and_ports": "warn"}, "degraded"),
        ({"recent_data": "warn", "canary": "pass"}, "degraded"),
    ],
)
def test_verdicts(spark, checks, verdict):
    rows = spark.createDataFrame([("s", c, s) for c, s in checks.items()], "scope string, check string, status string")
    assert health.verdict(rows).first().verdict == verdict


def test_retention_ages():
    assert health.retention_ages(30) == {"warm": 6, "cold": 15, "delete": 30}
    assert health.retention_ages(2) == {"warm": 1, "cold": 2, "delete": 2}


# ---------------------------------------------------------------- drift
def test_drift_cases(spark):
    cases = {
        "same": ('{"a": [1, {"b": null}]}', '{"a": [1.0, {"b": null, "more": 1}], "live": true}', []),
        "value": ('{"a": {"b": "1"}}', '{"a": {"b": 1}}', [("a.b", "value_mismatch")]),
        "missing": ('{"a": {"b": {"c": 1}}}', '{"a": {}}', [("a.b", "missing_in_remote")]),
        "length": ('{"a": [1, 2, 3]}', '{"a": [1, 9]}', [("a", "list_length_mismatch"), ("a[1]", "value_mismatch")]),
        "kind": ('{"a": {"b": 1}}', '{"a": [1]}', [("a", "value_mismatch")]),
        "gone": ('{"a": 1}', None, []),
    }
    local = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "asset string, body string")
    remote = spark.createDataFrame([(k, v[1]) for k, v in cases.items() if v[1]], "asset string, body string")
    out = sorted((r.asset, r.path, r.type) for r in drift(local, remote).collect() if r.asset != "gone")
    assert out == sorted((k, p, t) for k, v in cases.items() for p, t in v[2])
    status = {r.asset: r.status for r in drift_status(local, remote).collect()}
    assert status == {"same": "in_sync", "value": "drifted", "missing": "drifted", "length": "drifted", "kind": "drifted", "gone": "not_found"}
    assert overall(drift_status(local, remote)).first().overall_status == "drifted"


# ---------------------------------------------------------------- discovery
RULES = discovery.load_rules(
    {
        "runtime_entrypoint": {"priority": 98, "path_keywords": ["main.py"], "content_keywords": ["main()"], "signals": ["runs", "errors"]},
        "tool_registry": {"priority": 92, "path_keywords": ["tool"], "content_keywords": ["tool", "tool call"], "signals": ["tool_errors"]},
        "workflow_orchestrator": {"priority": 90, "path_keywords": [], "content_keywords": ["stage"], "signals": ["workflow_steps"]},
    }
)


def test_rule_scores_and_handlers(spark):
    files = spark.createDataFrame(
        [("w", "src/Main.py", "def main():\n  pass\nmain()\ndef  cmd_go (x): pass\ndef cmd_go(): pass"), ("w", "a.txt", "a Tool\tcall, toolbox"), ("w", "b.txt", "toolbox backstage")],
        "workspace string, path string, content string",
    )
    got = sorted((r.path, r.module_kind, r.score) for r in discovery.file_scores(files, RULES).collect())
    assert got == [("a.txt", "tool_registry", 6), ("src/Main.py", "runtime_entrypoint", 8)]
    assert [(r.handler) for r in discovery.command_handlers(files).collect()] == ["cmd_go"]
    found = discovery.modules(files, RULES)
    assert [(r.module_kind, r.score) for r in discovery.monitoring_plan(found).collect()] == [("runtime_entrypoint", 8), ("tool_registry", 6), ("command_handlers", 4)]
    row = discovery.maturity(discovery.profile(found)).first()
    assert (row.basic_logging, row.genai_instrumentation, row.operational_readiness, row.depth_bonus) == (11, 11, 5, 7)
    assert (row.score, row.level) == (34, "basic")


def test_framework_order(spark):
    files = [
        ("manifest", "requirements.txt", "CrewAI==1"), ("manifest", "a.py", "import autogen"),
        ("node", "package.json", '{"dependencies": {"@mastra/core": "1"}}'), ("node", "a.py", "import crewai"),
        ("imports", "b.py", "import autogen"), ("imports", "a.py", "from llama_index import x"), ("broken", "package.json", "{"), ("none", "x.md", "crewai"),
    ]
    out = discovery.frameworks(spark.createDataFrame(files, "workspace string, path string, content string")).collect()
    assert {r.workspace: r.framework for r in out} == {"manifest": "crewai", "node": "mastra", "imports": "llamaindex"}


# ---------------------------------------------------------------- filters
def test_severity_and_sampling(spark):
    logs = spark.createDataFrame([(1,), (9,), (13,), (None,)], "severity_number int")
    assert filters.min_severity(logs, "WARN").count() == 2 and filters.min_severity(logs, "trace").count() == 4 and filters.min_severity(logs, "").count() == 4
    spans = spark.range(4000).selectExpr("concat('t', id div 4) AS trace_id")
    kept = filters.sample_traces(spans, 0.3).groupBy("trace_id").count()
    assert kept.where("count <> 4").count() == 0 and 230 < kept.count() < 370
    assert filters.sample_traces(spans, 1.0).count() == 4000
    assert ordered_dimensions(["a", " ", "b", "a"]) == ["a", "b"]
    assert list(itertools.islice(ordered_dimensions(None), 1)) == ["service_name"]


# ---------------------------------------------------------------- hot keys and small helpers
def test_a_third_of_all_rows_under_one_parent(spark):
    """A star next to chains: every child arrives once, and ranks stay exact."""
    star = spark.range(3000).selectExpr("'s' AS scope", "concat('k', id) AS span_id", "'hub' AS parent_id", "id AS place")
    chains = spark.range(6000).selectExpr("'s' AS scope", "concat('c', id) AS span_id", "if(id % 6 = 0, NULL, concat('c', id - 1)) AS parent_id", "id + 3000 AS place")
    hub = spark.createDataFrame([("s", "hub", None, -1)], "scope string, span_id string, parent_id string, place bigint")
    depths = {r.depth: r["count"] for r in forest(star.union(chains).union(hub), "scope").groupBy("depth").count().collect()}
    assert depths == {0: 1001, 1: 4000, 2: 1000, 3: 1000, 4: 1000, 5: 1000}


def test_hot_session_in_every_list(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', concat('c', id)) AS k")
    top = terms(rows, "k", 2).collect()
    assert [(r.k, r["count"]) for r in top] == [("hot", 3000), ("c1", 1)]


def test_sketched_percentiles_in_alerts(spark):
    rows = events_of(spark, window_rows(errors=20, ms=12_000) + baseline_rows())
    exact_run = {r.alert_type: r.p95_ms for r in alerts.alerts(rows, as_of=NOW).collect()}
    sketched = {r.alert_type: r.p95_ms for r in alerts.alerts(rows, as_of=NOW, approx=True).collect()}
    assert sketched == exact_run and exact_run["latency_degradation"] == 12000.0


def test_alerts_per_window_use_only_earlier_windows(spark):
    day = 24 * 60
    rows = [{"ago": d * day + 60, "event_outcome": "failure" if i < d * 4 else "success", "conversation_id": f"c{i}", "input_tokens": 10 * d} for d in (1, 2, 3) for i in range(20)]
    wide = alerts.per_window(events_of(spark, rows), "1 day", "2 days", only=["error_rate_spike"])
    got = {r.scope: (r.errors, r.b_errors, r.b_events, r.b_tokens) for r in wide.collect()}
    assert got == {
        "all@2024-01-27 00:00:00": (12, 0, 0, 0), "all@2024-01-28 00:00:00": (8, 12, 20, 600), "all@2024-01-29 00:00:00": (4, 20, 40, 1000),
    }


def test_settings_files_and_shared_folder(spark, tmp_path, monkeypatch):
    from spanloom import session
    from spanloom.sources.events import append_metrics
    from spanloom.sources.files import read_config

    (tmp_path / "p.json").write_text('{"m": [1, 2]}')
    assert prices.prices(read_config(spark, str(tmp_path / "p.json")))["m"] == (1.0, 2.0)
    metrics = spark.createDataFrame([(BASE, 1)], "bucket timestamp, calls bigint")
    append_metrics(metrics, str(tmp_path / "metrics"))
    append_metrics(metrics, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).agg(F.sum("calls")).first()[0] == 2
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    assert session.shared_dir(spark)
