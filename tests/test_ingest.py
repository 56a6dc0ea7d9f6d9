"""Normalisation and OTLP sources on the golden events and hand-written payloads."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import normalize_text
from spanloom.operators.normalize import TRUNCATED, normalize
from spanloom.schema import DOTTED, FIELDS, CARRIED
from spanloom.sources import otlp
from spanloom.sources.feedback import feedback_events

NAMES = {dotted: name for name, dotted in DOTTED.items()}
KINDS = {name: kind for name, kind, _ in FIELDS + CARRIED}


def rows_of(spark, *events):
    """Hand rows given with dotted names."""
    used = sorted({NAMES[k] for e in events for k in e if k in NAMES})
    data = [tuple(e.get(DOTTED[name]) for name in used) for e in events]
    kinds = ", ".join(f"{n} {'string' if n == 'ts' else KINDS[n]}" for n in used)
    return spark.createDataFrame(data, kinds)


def one(spark, event, **options):
    return normalize(rows_of(spark, event), **options).collect()[0]


def test_fields_given_on_the_row_pass_through(spark):
    row = one(
        spark,
        {
            "@timestamp": "2026-04-01T12:00:00Z", "event.action": "tool_call", "event.outcome": "success", "service.name": "agent-runtime",
            "gen_ai.tool.name": "web_search", "gen_ai.agent_ext.latency_ms": 350.5, "gen_ai.agent_ext.retry_count": 2,
            "gen_ai.usage.input_tokens": 1200, "gen_ai.agent_ext.cost": 0.05, "message": "plain text",
        },
    )
    assert (row.event_action, row.event_outcome, row.tool_name) == ("tool_call", "success", "web_search")
    assert row.latency_ms == 350.5 and row.retry_count == 2 and row.input_tokens == 1200 and row.cost == 0.05
    assert row.event_duration == 350_500_000 and row.event_kind == "event" and row.event_category == "process"
    assert row.ts.isoformat().startswith("2026-04-01T12:00")


def test_json_message_fills_missing_fields(spark):
    body = {"event": {"action": "tool_call"}, "gen_ai": {"tool": {"name": "file_read"}, "agent_ext": {"latency_ms": 42.0}}, "service": {"name": "m"}}
    row = one(spark, {"message": json.dumps(body)})
    assert (row.tool_name, row.latency_ms, row.service_name, row.event_action) == ("file_read", 42.0, "m", "tool_call")
    assert row.event_duration == 42_000_000


def test_message_never_overwrites_and_first_spelling_wins(spark):
    body = '{"gen_ai": {"tool": {"name": "from_message"}}, "gen_ai.request.model": "m1", "event": {"outcome": "failure"}}'
    row = one(spark, {"message": body, "gen_ai.tool.name": "given"})
    assert (row.tool_name, row.request_model, row.event_outcome) == ("given", "m1", "failure")


def test_mixed_nesting_and_four_levels(spark):
    body = {
        "gen_ai": {"tool.name": "dotted_inside", "agent_ext": {"reasoning": {"action": "delegate", "step_index": 3}, "causality": {"trigger_span_id": "s1"}}},
    }
    row = one(spark, {"message": json.dumps(body)})
    assert (row.tool_name, row.reasoning_action, row.reasoning_step_index, row.trigger_span_id) == ("dotted_inside", "delegate", 3, "s1")


def test_unknown_roots_go_to_unmapped(spark):
    body = {"k": 69, "odd": {"a": [1, 2]}, "x.y": True, "service": {"name": "s", "tier": "gold"}}
    row = one(spark, {"message": json.dumps(body)})
    assert row.unmapped == {"k": "69", "odd": '{"a":[1,2]}', "x.y": "true", "service.tier": "gold"}
    assert row.service_name == "s"


@pytest.mark.parametrize("message", ["not json", "42", '"text"', "[1, 2]", "{broken", "", None])
def test_other_messages_are_left_alone(spark, message):
    row = one(spark, {"message": message, "gen_ai.tool.name": "t"})
    assert row.message == message and row.unmapped is None and row.event_outcome == "success"


def test_outcome_from_error_type(spark):
    assert one(spark, {"message": "x", "error.type": "timeout"}).event_outcome == "failure"
    assert one(spark, {"message": '{"error": {"type": "timeout"}}'}).event_outcome == "failure"


def test_sensitive_payloads_are_dropped_everywhere(spark):
    body = {"gen_ai": {"prompt": "hunter2", "tool": {"name": "t", "call": {"id": "c", "arguments": {"q": "hunter2"}, "result": "hunter2"}}}, "gen_ai.completion": "hunter2"}
    row = one(spark, {"message": json.dumps(body)})
    assert row.tool_name == "t" and row.tool_call_id == "c"
    assert "hunter2" not in str(row)


def test_long_text_is_cut(spark):
    row = one(
        spark,
        {"message": "x", "gen_ai.agent_ext.reasoning.rationale": "r" * 501, "gen_ai.agent_ext.reasoning.input_summary": "i" * 300, "gen_ai.feedback.comment": "c" * 1200},
    )
    assert row.reasoning_rationale == "r" * 500 + TRUNCATED
    assert row.reasoning_input_summary == "i" * 300
    assert row.feedback_comment == "c" * 1000 + TRUNCATED


def test_unreadable_values_are_named(spark):
    row = one(spark, {"message": '{"gen_ai": {"agent_ext": {"latency_ms": "soon"}}}'})
    assert row.latency_ms is None and "gen_ai.agent_ext.latency_ms" in row.ingest_error


def test_stamps_and_resource_override(spark):
    row = one(spark, {"message": "x", "service.name": "a", "observer.type": "bridge"}, modules=["m1"], resource={"service_name": "b", "service_environment": "prod"})
    assert (row.service_name, row.service_environment, row.observer_type, row.recommended_modules) == ("b", "prod", "event-normaliser", ["m1"])


def test_only_schema_columns_come_out(spark):
    out = normalize(spark.createDataFrame([("x", 1)], "message string, stray int"))
    assert out.columns == [n for n, _, _ in FIELDS + CARRIED]


def attr(key, **value):
    return {"key": key, "value": value}


def log_payload(**record):
    return {
        "resourceLogs": [
            {
                "resource": {"attributes": [attr("service.name", stringValue="from-resource"), attr("x", stringValue="resource")]},
                "scopeLogs": [
                    {
                        "scope": {"name": "sc", "version": "1", "attributes": [attr("x", stringValue="scope")]},
                        "logRecords": [record],
                    }
                ],
            }
        ]
    }


def write_json(tmp_path, *payloads):
    file = tmp_path / "payload.json"
    file.write_text("\n".join(json.dumps(p) for p in payloads), encoding="utf-8")
    return str(tmp_path)


def test_otlp_logs(spark, tmp_path):
    path = write_json(
        tmp_path,
        log_payload(
            timeUnixNano="1700000000123456789", severityNumber=17, severityText=" ERROR ", traceId="ABC", spanId="Def",
            body={"stringValue": "hello"},
            attributes=[
                attr("x", stringValue="record"), attr(" ", stringValue="blank"), attr("gen_ai.prompt", stringValue="secret"),
                attr("gen_ai.usage.input_tokens", intValue="12"), attr("gen_ai.agent_ext.cache_hit", boolValue=False),
                attr("gen_ai.agent_ext.cost", doubleValue=0.5),
                attr("list", arrayValue={"values": [{"intValue": "1"}, {"stringValue": "a"}, {"kvlistValue": {"values": [attr("k", boolValue=True)]}}]}),
            ],
        ),
        log_payload(body={"kvlistValue": {"values": [attr("b", intValue="2"), attr("a", stringValue="t")]}}, timeUnixNano="-5"),
    )
    first, second = otlp.read_logs(spark, path).orderBy(F.col("ts").desc()).collect()
    assert first.ts.strftime("%s.%f").endswith(".123456") and first.event_action == "otlp.log"
    assert (first.service_name, first.trace_id, first.span_id, first.log_level, first.severity_number) == ("from-resource", "abc", "def", "error", 17)
    assert first.input_tokens == 12 and first.cache_hit is False and first.cost == 0.5
    assert first.unmapped == {"x": "record", "list": '[1, "a", {"k": true}]'}
    assert first.message == "hello" and first.log_body is None
    assert second.message == '{"a": "t", "b": 2}' and second.log_body == second.message
    assert second.ts.year == 1970


def test_otlp_logs_legacy_scope_and_defaults(spark, tmp_path):
    path = write_json(
        tmp_path,
        {"resourceLogs": [{"instrumentationLibraryLogs": [{"instrumentationLibrary": {"name": "old"}, "logRecords": [{"body": {"stringValue": "x"}, "attributes": [attr("event.action", stringValue="act")]}]}]}]},
    )
    row = otlp.read_logs(spark, path).collect()[0]
    assert (row.otel_scope_name, row.event_action, row.service_name) == ("old", "act", "unknown-service") and row.ts is not None


def span(**fields):
    return {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [fields]}]}]}


def test_otlp_traces(spark, tmp_path):
    path = write_json(
        tmp_path,
        span(name="a", kind=3, traceId="T1", spanId="S1", parentSpanId="P1", startTimeUnixNano="1000000000", endTimeUnixNano="3000000000", status={"code": 2}),
        span(name="b", kind="SPAN_KIND_SERVER", startTimeUnixNano="5000000000", endTimeUnixNano="4000000000", status={"code": "STATUS_CODE_OK"}),
        span(name="c", endTimeUnixNano="6000000000", status={"code": 2}, attributes=[attr("event.outcome", stringValue="success")]),
        span(startTimeUnixNano="7000000000"),
    )
    a, b, c, d = otlp.read_traces(spark, path).orderBy("ts").collect()
    assert (a.event_action, a.message, a.span_kind, a.event_outcome, a.event_duration, a.parent_id) == ("a", "a", "client", "failure", 2_000_000_000, "p1")
    assert (b.span_kind, b.event_outcome, b.event_duration) == ("server", "success", None)
    assert (c.event_outcome, c.event_duration) == ("success", None)
    assert (d.event_action, d.message, d.event_outcome) == ("otlp.span", None, None)


def test_feedback_rows(spark):
    rows = spark.createDataFrame(
        [("1", None, "good", "t", None, "u", None), ("-1", "", None, None, "s", None, "svc"), ("0", None, None, None, None, None, None), ("many", None, None, None, None, None, None), (None, "positive", None, None, None, None, None)],
        "score string, sentiment string, comment string, trace_id string, session_id string, user_id string, service_name string",
    )
    out = feedback_events(rows).collect()
    assert [r.feedback_sentiment for r in out] == ["positive", "negative", "neutral", None, "positive"]
    assert out[0].trace_id == out[0].feedback_trace_id == "t" and out[0].message == "good" and out[0].service_name == "user-feedback"
    assert out[1].conversation_id == "s" and out[1].service_name == "svc"
    assert out[3].feedback_score is None


def test_text_lines(spark):
    text = "  a \t b\r\n\r\n \rc  d\n\n"
    assert spark.createDataFrame([(text,)], "t string").select(normalize_text(F.col("t"))).collect()[0][0] == "a b\nc d"
