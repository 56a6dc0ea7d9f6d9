"""Streams over several batches: sessions, joins of two streams, open windows, alert baselines in state."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.plans import alerts, health
from spanloom.session import ROCKSDB, STATE_STORE, with_rocksdb
from spanloom.streaming import ingest, joins, metrics, sessions, watch

DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def runner(spark, tmp_path, schema, make, label):
    """Feeds rows batch by batch; each call gives all that was written so far."""
    landing, out, checkpoint = (str(tmp_path / f"{label}-{x}") for x in ("in", "out", "cp"))
    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = make(spark.readStream.schema(schema).parquet(landing))
        ingest.start(stream, out, checkpoint, ()).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    return feed


EVENTS = "conversation_id string, ts timestamp, event_outcome string, retry_count int, input_tokens bigint, output_tokens bigint, service_name string"


def event(who, minute, outcome="success"):
    return who, at(minute), outcome, 1, 10, 5, "svc"


def test_sessions_merge_across_batches_and_close_once(spark, tmp_path):
    feed = runner(spark, tmp_path, EVENTS, lambda s: sessions.session_activity(s, "30 minutes", "10 minutes"), "sessions")
    assert feed([event("a", 0), event("a", 35), event("b", 5), event(None, 7)]).count() == 0
    # The row at 28 joins what were two sessions of a; that of b closes with the row of c.
    assert feed([event("a", 28, "failure"), event("c", 60)]).count() == 1
    found = feed([event("d", 200), event("b", 6)])  # b's late row comes after its session was written
    rows = {r.conversation_id: (r.session_start, r.session_end, r.rows, r.failures, r.tokens_in) for r in found.collect()}
    assert rows == {"a": (at(0), at(35), 3, 1, 30), "b": (at(5), at(5), 1, 0, 10), "c": (at(60), at(60), 1, 0, 10)}
    assert feed([event("e", 500)]).groupBy("conversation_id").count().where("count > 1").count() == 0


def test_sessions_of_a_table_and_gaps_by_value(spark):
    rows = [event("a", 0), event("a", 30), event("a", 61), event("a", 61)]
    table = spark.createDataFrame(rows, EVENTS)
    assert sorted(r.rows for r in sessions.session_activity(table, "30 minutes").collect()) == [2, 2]
    assert [r.rows for r in sessions.session_activity(table, sessions.gap_of("30 minutes", {"svc": "2 hours"})).collect()] == [4]
    shape = sessions.session_shape(sessions.session_activity(table, "30 minutes")).first()
    assert (shape.sessions, shape.rows, shape.active_us, shape.longest_pause_us) == (2, 4, 30 * 60 * 10**6, 31 * 60 * 10**6)
    assert sessions.session_activity(table.limit(0)).count() == 0


BOTH = "side string, feedback_id bigint, ts timestamp, trace_id string, feedback_score double, span_id string, parent_id string, event_action string, event_outcome string, event_duration bigint"


def test_feedback_waits_for_late_roots_and_gives_up_once(spark, tmp_path):
    def said(i, minute, trace):
        return "f", i, at(minute), trace, 1.0, None, None, None, None, None

    def root(trace, minute, span="r", parent=None):
        return "t", None, at(minute), trace, None, span, parent, "act", "success", 5

    def make(s):
        return joins.feedback_with_traces(s.where("side = 'f'"), s.where("side = 't'"), "60 minutes", "30 minutes", "10 minutes")

    feed = runner(spark, tmp_path, BOTH, make, "feedback")
    first = feed([said(1, 60, "early"), said(1, 60, "early"), root("early", 55), said(2, 61, "late"), said(3, 62, "never"), said(4, 63, None), root("early", 56, "child", "r")])
    assert [(r.feedback_id, r.root) for r in first.collect()] == [(1, "r")]
    second = feed([root("late", 70), root("late", 70), root("early", 55)])  # repeated roots count once
    assert sorted((r.feedback_id, r.root) for r in second.collect()) == [(1, "r"), (2, "r")]
    third = feed([said(5, 300, "x"), root("y", 300)])  # the watermark has passed what the third could wait for
    assert sorted((r.feedback_id, r.root) for r in third.collect()) == [(1, "r"), (2, "r"), (3, None)]
    fourth = feed([root("never", 300), said(6, 700, "z"), root("z", 900)])
    assert sorted((r.feedback_id, str(r.root)) for r in fourth.collect()) == [(1, "r"), (2, "r"), (3, "None"), (5, "None")]


CANARY = "side string, verify_id string, ts timestamp, send_ok boolean, status_code int, event_dataset string, service_name string"


def test_canaries_of_two_streams_equal_the_tables(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        ok = i % 9 > 0
        rows.append(("s", f"c{i}", at(i), ok, None if i % 2 else 503, None, None))
        if ok and i % 5:
            rows.append(("l", f"c{i}", at(i + rng.choice([0, 5, 14, 16, 40])), None, None, health.CANARY_DATASET if i % 7 else "x", "svc" if i % 11 else ""))
    feed = runner(spark, tmp_path, CANARY, lambda s: joins.canaries_landed(s.where("side = 's'"), s.where("side = 'l'")), "canary")
    early, late = [r for r in rows if r[2] <= at(25)], [r for r in rows if r[2] > at(25)]
    feed(early + early[:10])
    feed(late)
    found = feed([("s", "end", at(1000), True, 200, None, None), ("l", "other", at(1000), None, None, None, None)])
    table = spark.createDataFrame(rows, CANARY)
    sent = table.where("side = 's'")
    near = table.where("side = 'l'").withColumnRenamed("ts", "landed").join(sent.select("verify_id", "ts"), "verify_id").where("landed <= ts + INTERVAL 15 MINUTES")
    batch = health.canaries(sent, near.select("verify_id", "ts", "event_dataset", "service_name"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert {r.verdict for r in batch.collect()} == {"ok", "contract_broken", "sent_but_lost", "transport_rejected", "transport_unreachable"}


def test_live_metrics_show_open_windows(spark, tmp_path):
    schema = f"{EVENTS}, event_duration bigint, request_model string, tool_name string"
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for minute, calls in ((1, 1), (2, 2), (65, 1)):
        spark.createDataFrame([(*event("a", minute), 7, "m", "t")], schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        metrics.keep_live(stream, out, str(tmp_path / "cp"), "1 hour", ["service_name"]).awaitTermination()
        live = {r.bucket: r.calls for r in metrics.read_live(spark, out, ["service_name"]).collect()}
        assert live[at(minute - minute % 60)] == calls
    assert live == {at(0): 2, at(60): 1}


# ---------------------------------------------------------------- baselines in state

WATCHED = "ts timestamp, event_outcome string, event_dataset string, event_duration bigint, input_tokens bigint, output_tokens bigint, retry_count int, latency_ms double, conversation_id string, turn_id string, component_type string, tool_name string, request_model string, error_type string, service_name string"


def watched_rows(days=9):
    rng = random.Random(7)
    out = []
    for day in range(days):
        if day in (3, 4):  # silent days leave a gap in the state
            continue
        for _ in range(rng.choice([20, 60])):
            bad = rng.random() < (0.6 if day % 3 == 0 else 0.1)
            out.append((
                at(day * 1440 + rng.randrange(1440)), "failure" if bad else "success", rng.choice([None, None, "internal.alert_check"]), rng.choice([None, rng.randrange(10**9, 10**11)]),
                rng.choice([None, rng.randrange(5000)]), 7, rng.choice([0, 0, 4]), rng.random() * 9000, rng.choice(["s1", "s2", None]), rng.choice(["t1", "t2", None]), rng.choice(["tool", "llm", None]),
                rng.choice(["x", "y", None]), rng.choice(["m", None]), "timeout" if bad else None, rng.choice(["a", "b", None]),
            ))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("baseline", ["2 days", "7 days"])
def test_watch_equals_the_batch_over_many_batches(spark, tmp_path, baseline):
    rows = watched_rows()
    rules = alerts.Rules(token_threshold_multiplier=0.3)
    landing, facts, out, written = (str(tmp_path / x) for x in ("in", "facts", "out", "rows"))
    step = -(-len(rows) // 3)
    for k in range(3):
        spark.createDataFrame(rows[k * step : (k + 1) * step], WATCHED).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(WATCHED).parquet(landing)
        watch.roll_up(stream, facts, str(tmp_path / "cp1"), "1 day", ["service_name"], "1 minute").awaitTermination()
        watch.watch(spark, facts, out, str(tmp_path / "cp2"), "1 day", baseline, rules, rows_out=written).awaitTermination()
    wide = alerts.per_window(spark.createDataFrame(rows, WATCHED), "1 day", baseline, rules, ["service_name"])
    last = max(r[0] for r in rows).replace(hour=0, minute=0, second=0)
    want = alerts.analyze(wide).where(~F.col("scope").endswith(str(last)))
    columns = [c for c in want.columns if c != "batch"]

    def shown(df):
        return sorted(str(r) for r in df.select(columns).collect())

    found = spark.read.parquet(out)
    assert shown(found) == shown(want)
    assert {"latency_degradation", "error_rate_spike"} <= {r.alert_type for r in found.collect()}
    quiet = spark.read.parquet(written).where("event_action = 'alert_check_ok'").count()
    assert quiet == wide.where(~F.col("scope").endswith(str(last))).count() - found.select("scope").distinct().count()


def test_watch_runs_in_a_session_with_the_default_state_store(spark, tmp_path):
    plain, default = spark.newSession(), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain.conf.set(STATE_STORE, default)
    plain.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    own = with_rocksdb(plain)
    assert (own.conf.get(STATE_STORE), own.conf.get("spark.sql.session.timeZone")) == (ROCKSDB, "Asia/Tokyo") and with_rocksdb(own) is own
    plain.conf.set("spark.sql.session.timeZone", "UTC")
    rows = watched_rows(3)
    landing, facts, out = (str(tmp_path / x) for x in ("in", "facts", "out"))
    plain.createDataFrame(rows, WATCHED).write.parquet(landing)
    watch.roll_up(plain.readStream.schema(WATCHED).parquet(landing), facts, str(tmp_path / "cp1"), "1 day", ["service_name"], "1 minute").awaitTermination()
    watch.watch(plain, facts, out, str(tmp_path / "cp2"), "1 day", "7 days").awaitTermination()
    last = str(max(r[0] for r in rows).replace(hour=0, minute=0, second=0))
    want = alerts.analyze(alerts.per_window(plain.createDataFrame(rows, WATCHED), "1 day", "7 days", by=["service_name"])).where(~F.col("scope").endswith(last))
    found = [sorted((r.scope, r.alert_type, r.severity) for r in df.collect()) for df in (plain.read.parquet(out), want)]
    assert found[0] == found[1] != []
    assert plain.conf.get(STATE_STORE) == default


def test_merged_histograms_and_ranks():
    rng = np.random.default_rng(1)
    baseline = watch.Baseline(1, 10)
    values = np.sort(rng.integers(0, 50, 333))
    left, right = (np.stack(np.unique(part, return_counts=True)).astype(np.int64) for part in (values[::2], values[1::2]))
    both = watch.merged(left, right)
    assert (both == np.stack(np.unique(values, return_counts=True))).all()
    assert (watch.merged(both, right, -1) == left).all()
    n, low, before, high, _ = baseline.rank(both)
    place = (n - 1) * 0.95
    assert (n, low, high) == (333, values[int(place)], values[int(np.ceil(place))]) and before == (values < low).sum()
    assert baseline.rank(np.zeros((2, 0), np.int64)) == (0, None, None, None, None)
