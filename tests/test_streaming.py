"""Streams: restartable ingest, repeats, files, and the stored table."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators.normalize import normalize
from spanloom.plans import alerts
from spanloom.session import scratch_path
from spanloom.sources import events as store
from spanloom.sources import files
from spanloom.streaming import ingest
from spanloom.streaming.alerts import closed_windows, watch


def payload(second, action="a", span="s1"):
    return json.dumps(
        {
            "resourceSpans": [
                {
                    "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]},
                    "scopeSpans": [{"spans": [{"name": action, "traceId": "T", "spanId": span, "startTimeUnixNano": str((1_700_000_000 + second) * 10**9), "endTimeUnixNano": str((1_700_000_001 + second) * 10**9)}]}],
                }
            ]
        }
    )


def run(spark, landing, table, checkpoint):
    ingest.ingest(spark, "traces", str(landing), table, checkpoint, interval=None).awaitTermination()
    return store.scan(spark, table)


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    landing, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "cp")
    landing.mkdir()
    (landing / "1.json").write_text(payload(0) + "\n" + payload(5, "b"))
    first = run(spark, landing, table, checkpoint)
    assert sorted(r.event_action for r in first.collect()) == ["a", "b"]
    (landing / "2.json").write_text(payload(9, "c"))
    again = run(spark, landing, table, checkpoint)
    rows = again.orderBy("ts").collect()
    assert [r.event_action for r in rows] == ["a", "b", "c"]
    assert {r.event_duration for r in rows} == {10**9} and {r.service_name for r in rows} == {"svc"} and {r.event_outcome for r in rows} == {"success"}


def test_repeats_are_dropped_only_on_request(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text("\n".join([payload(0), payload(0), payload(1, span="s2")]))
    for drop, want in ((False, 3), (True, 2)):
        stream = ingest.open_stream(spark, "traces", str(landing))
        stream = ingest.drop_repeats(stream) if drop else stream
        out = scratch_path(spark, "repeats")
        ingest.start(store.conform(stream), out, scratch_path(spark, "cp")).awaitTermination()
        assert spark.read.parquet(out).count() == want


def test_closed_windows_trigger_alerts(spark, tmp_path):
    """The first day fails a lot; the second day only closes it."""
    path = str(tmp_path / "events")
    rows = spark.range(60).selectExpr(
        "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * if(id < 40, 60, 3600)) AS ts", "if(id < 30, 'failure', 'success') AS event_outcome",
        "'s1' AS conversation_id", "'t' AS tool_name", "'t1' AS turn_id", "concat('sp', id) AS span_id",
    )
    store.append(rows, path)
    table = store.scan(spark, path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    out = str(tmp_path / "alerts")
    watch(spark, stream, lambda: store.scan(spark, path), out, str(tmp_path / "cp"), "1 day", "7 days", alerts.Rules(), delay="1 hour").awaitTermination()
    found = spark.read.parquet(out).select("scope", "alert_type", "severity").collect()
    assert {(r.scope, r.alert_type) for r in found} == {("all@2024-01-01 00:00:00", "error_rate_spike"), ("all@2024-01-01 00:00:00", "session_failure_hotspot")}
    assert closed_windows(stream).isStreaming


def test_stored_table_and_written_rows(spark, tmp_path):
    path = str(tmp_path / "events")
    audits = spark.createDataFrame([("doctor", "healthy", 12.0, {"a": "b"}), ("eval", "fail", None, None)], "tool string, verdict string, duration_ms double, inputs map<string,string>")
    store.append(store.audit_events(audits), path)
    rows = {r.tool_name: r for r in store.scan(spark, path, since="now-1d").collect()}
    assert (rows["doctor"].event_outcome, rows["eval"].event_outcome) == ("success", "failure")
    assert rows["doctor"].audit_inputs == {"a": "b"} and rows["doctor"].event_dataset == "internal.skill_audit"
    assert store.scan(spark, path, until="now-1d").count() == 0
    store.write_report(spark.range(2), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_log_files_and_text_trees(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"service": {"name": "s"}}\nplain\n\n')
    (tmp_path / "other.txt").write_text("no")
    rows = normalize(files.read_log_files(spark, str(tmp_path))).select("message", "service_name").collect()
    assert sorted((r.message, r.service_name) for r in rows) == [("plain", None), ('{"service": {"name": "s"}}', "s")]

    tree = tmp_path / "tree"
    for name, data in {
        "a.py": b"x = 1", "sub/b.MD": "é".encode(), "sub/latin.txt": b"\xe9t\xe9", "bom.txt": b"\xef\xbb\xbfhi", "node_modules/c.py": b"no", "d.bin": b"no",
        "Dockerfile": b"FROM x", "big.txt": b"x" * 200_001, ".env": b"K=1",
    }.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    got = {r.path: (r.content, r.readable) for r in files.read_text_tree(spark, str(tree)).collect()}
    assert got.pop("big.txt") == ("x" * 200_001, True)
    assert got.pop("sub/latin.txt") == ("\ufffdt\ufffd", False)  # not UTF-8: reported
    assert got == {"a.py": ("x = 1", True), "sub/b.MD": ("é", True), "bom.txt": ("hi", True), "Dockerfile": ("FROM x", True)}
    assert {r.path for r in files.read_text_tree(spark, str(tree), max_bytes=10).collect()} == {*got, "sub/latin.txt"}


LOG = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [
    {"timeUnixNano": "1700000000000000000", "severityNumber": 9, "body": {"stringValue": "{\"gen_ai\": {\"tool\": {\"name\": \"t\"}}}"}, "spanId": "A"},
    {"timeUnixNano": "1700000001000000000", "severityText": "warn", "body": {"intValue": "5"}},
]}]}]}
LANDING = {
    "logs": ("a.json", json.dumps(LOG), {("t", "otlp.log"), (None, "otlp.log")}),
    "feedback": ("b.json", json.dumps({"score": 1, "trace_id": "x"}) + "\n" + json.dumps({"score": -1}), {(None, "user_feedback")}),
    "files": ("c.log", '{"gen_ai": {"tool": {"name": "f"}}, "event": {"action": "act"}}\nplain line\n', {("f", "act"), (None, None)}),
}


@pytest.mark.parametrize("kind", sorted(LANDING))
def test_stream_and_batch_give_the_same_rows(spark, tmp_path, kind):
    name, text, want = LANDING[kind]
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / name).write_text(text)
    table = str(tmp_path / "table")
    ingest.ingest(spark, kind, str(landing), table, str(tmp_path / "cp"), interval=None).awaitTermination()
    columns = [c for c in store.scan(spark, table).columns if c not in ("ts", "event_date")]
    streamed = store.scan(spark, table).select(columns)
    batch = normalize(ingest.SOURCES[kind](spark, str(landing))).select(columns)
    assert {(r.tool_name, r.event_action) for r in streamed.collect()} == want
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert streamed.count() == 2


def test_a_large_row_group_is_not_one_task_of_the_sink(spark, tmp_path):
    landing, out = str(tmp_path / "one"), str(tmp_path / "table")
    rows = spark.range(2000).selectExpr("timestamp_seconds(1704067200 + id) AS ts", "'s' || id AS span_id", "map('id', id) AS more", "array(id) AS some")
    rows.unionByName(rows.where("span_id = 's1'")).coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing).withColumn("event_date", F.to_date("ts"))
    ingest.start(stream, out, str(tmp_path / "deal"), ["event_date"]).awaitTermination()
    files = [r["count"] for r in spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 2001 and 1 < len(files) <= ingest.SLICES and max(files) < 1000
    assert spark.read.parquet(out).where("span_id = 's1'").count() == 2
