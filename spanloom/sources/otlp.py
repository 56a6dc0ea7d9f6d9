"""OTLP JSON (logs and traces) as flat event rows, for batch and stream.

The nested payload is declared, not inferred. An attribute value is one of several
alternatives; the scalar ones are read as text, only arrays and key-value lists are
read as variants because their shape differs per record and nests to any depth.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import declared_names, is_sensitive, with_map
from ..schema import CARRIED, COLUMN_TYPES, FIELDS

_VALUE = (
    "struct<stringValue: string, boolValue: string, intValue: string, doubleValue: string, bytesValue: string, "
    "arrayValue: variant, kvlistValue: variant>"
)
_ATTRIBUTES = f"attributes: array<struct<key: string, value: {_VALUE}>>"
_SCOPE = f"struct<name: string, version: string, {_ATTRIBUTES}>"


def _schema(signal: str, blocks: str, legacy: str, records: str, record: str) -> str:
    group = f"array<struct<scope: {_SCOPE}, instrumentationLibrary: {_SCOPE}, {records}: array<struct<{record}, {_ATTRIBUTES}>>>>"
    return f"{signal} array<struct<resource: struct<{_ATTRIBUTES}>, {blocks}: {group}, {legacy}: {group}>>"


OTLP_LOGS = _schema(
    "resourceLogs", "scopeLogs", "instrumentationLibraryLogs", "logRecords",
    "timeUnixNano: string, time_unix_nano: string, observedTimeUnixNano: string, observed_time_unix_nano: string, "
    "severityNumber: string, severity_number: string, severityText: string, severity_text: string, body: " + _VALUE + ", "
    "traceId: string, trace_id: string, spanId: string, span_id: string",
)
OTLP_TRACES = _schema(
    "resourceSpans", "scopeSpans", "instrumentationLibrarySpans", "spans",
    "name: string, kind: string, traceId: string, trace_id: string, spanId: string, span_id: string, "
    "parentSpanId: string, parent_span_id: string, startTimeUnixNano: string, start_time_unix_nano: string, "
    "endTimeUnixNano: string, end_time_unix_nano: string, status: struct<code: string>",
)

_SCALARS = ("stringValue", "intValue", "boolValue", "doubleValue", "bytesValue")


def _plain(value):
    """What an attribute value stands for; what is no attribute value stays as received."""
    if not isinstance(value, dict):
        return value
    if value.get("intValue") is not None:
        text = str(value["intValue"])
        return int(text) if text.removeprefix("-").isdigit() else text
    for name in ("stringValue", "boolValue", "doubleValue", "bytesValue"):
        if value.get(name) is not None:
            return value[name]
    if isinstance(value.get("arrayValue"), dict):
        return [_plain(v) for v in value["arrayValue"].get("values") or ()]
    if isinstance(value.get("kvlistValue"), dict):
        pairs = ((str(e.get("key") or "").strip(), _plain(e.get("value"))) for e in value["kvlistValue"].get("values") or () if isinstance(e, dict))
        return dict(sorted((p for p in pairs if p[0]), key=lambda p: p[0]))
    return value


def _nested_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(_plain(json.loads(text)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nested_texts(column: pd.Series) -> pd.Series:
    """Arrays and key-value lists as JSON, however deep; built-in functions cannot recurse."""
    return column.map(lambda texts: None if texts is None else [_nested_text(t) for t in texts])


def _parts(value: str) -> str:
    """An attribute value as text: scalars at once; of an array or a list the JSON that is still to be decoded."""
    scalars = ", ".join(f"{value}.{name}" for name in _SCALARS)
    array, pairs = (f"to_json(named_struct('{n}', {value}.{n}))" for n in ("arrayValue", "kvlistValue"))
    nested = f"CASE WHEN coalesce({scalars}) IS NOT NULL THEN NULL WHEN {value}.arrayValue IS NOT NULL THEN {array} WHEN {value}.kvlistValue IS NOT NULL THEN {pairs} END"
    return f"'text', coalesce({scalars}), 'nested', {nested}"


def _decoded(df: DataFrame, column: str) -> DataFrame:
    """Replace an array of (key, text, nested) by (key, value). Only rows that hold something nested carry it over."""
    some = f"exists({column}, e -> e.nested IS NOT NULL)"
    df = df.withColumn("_nested", _nested_texts(F.expr(f"CASE WHEN {some} THEN transform({column}, e -> e.nested) END")))
    return df.withColumn(column, F.expr(f"transform({column}, (e, i) -> named_struct('key', e.key, 'value', coalesce(e.text, _nested[i])))")).drop("_nested")


def _attribute_map(df: DataFrame, *groups: str, body: str | None = None) -> DataFrame:
    """Add ``attrs``: a later group and a later entry win; blank keys, nulls and payloads are dropped.

    With ``body``, that value is decoded along into ``_body``.
    """
    every = ", ".join(f"coalesce({group}, array())" for group in groups)
    pairs = f"transform(reverse(concat({every})), e -> named_struct('key', trim(e.key), {_parts('e.value')}))"
    if body:
        pairs = f"concat(array(named_struct('key', '', {_parts(body)})), {pairs})"
    rows = _decoded(df.withColumn("_pairs", F.expr(pairs)), "_pairs")
    if body:
        rows = rows.withColumn("_body", F.expr("_pairs[0].value"))
    kept = F.filter("_pairs", lambda e: (e["key"] != "") & e["value"].isNotNull() & ~is_sensitive(e["key"]))
    return with_map(rows.withColumn("_pairs", kept), "_pairs", "attrs")


def nanos_to_timestamp(nanos: Column, fallback: Column) -> Column:
    """Microsecond time of a nanosecond count; negative counts as zero, unreadable as ``fallback``."""
    count = F.trim(nanos).try_cast("decimal(38,0)").try_cast("bigint")
    micros = F.floor(F.greatest(count, F.lit(0)).cast("decimal(20,0)") / F.lit(1000)).cast("bigint")
    return F.coalesce(F.timestamp_micros(micros), fallback.cast("timestamp"))


def _text(*names: str) -> Column:
    """First non-blank of several spellings, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.col(f"r.{name}")), F.lit("")) for name in names])


def status_outcome(code: Column) -> Column:
    upper = F.upper(code)
    return F.when(upper.endswith("ERROR") | (code == "2"), "failure").when(upper.endswith("OK") | (code == "1"), "success")


# Span kinds by number.
SPAN_KINDS = ("internal", "server", "client", "producer", "consumer")


def span_kind(kind: Column) -> Column:
    number = kind.try_cast("int")
    named = F.nullif(F.lower(F.element_at(F.split(kind, "_"), -1)), F.lit(""))
    numbered = F.get(F.array(*[F.lit(k) for k in SPAN_KINDS]), number - 1)
    return F.when(number.isNotNull(), numbered).otherwise(named)


def severity_number(value: Column, text: Column) -> Column:
    """Severity as a number; names of the enumeration and plain level names are understood."""
    name = F.upper(F.regexp_replace(F.coalesce(value, text), "^SEVERITY_NUMBER_", ""))
    band = F.regexp_extract(name, "^([A-Z]+)", 1)
    step = F.coalesce(F.nullif(F.regexp_extract(name, "([2-4])$", 1), F.lit("")).cast("int") - 1, F.lit(0))
    base = F.create_map(*[F.lit(x) for pair in (("TRACE", 1), ("DEBUG", 5), ("INFO", 9), ("WARN", 13), ("WARNING", 13), ("ERROR", 17), ("FATAL", 21)) for x in pair])
    return F.coalesce(value.try_cast("int"), base[band] + step)


def _exploded(payloads: DataFrame, signal: str, blocks: str, legacy: str, records: str) -> DataFrame:
    groups = payloads.select(F.explode(signal).alias("b")).select(
        F.col("b.resource.attributes").alias("res"),
        F.explode(F.when(F.size(f"b.{blocks}") > 0, F.col(f"b.{blocks}")).otherwise(F.col(f"b.{legacy}"))).alias("g"),
    )
    scope = F.coalesce("g.scope", "g.instrumentationLibrary")
    return groups.select("res", scope.alias("scope"), F.explode(f"g.{records}").alias("r"))


def _to_events(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Derived values first, then attributes of the same name; the rest goes to ``unmapped``."""
    declared = declared_names()
    rest = F.map_filter("attrs", lambda k, v: ~F.array_contains(declared, k))
    named = rows.select("attrs", *[column.cast(COLUMN_TYPES[name]).alias(name) for name, column in derived.items()])
    columns = []
    for name, kind, dotted in FIELDS + CARRIED:
        attribute = "NULL" if "<" in kind else f"try_cast(attrs['{dotted}'] AS {kind})"
        columns.append(f"CAST({f'coalesce({name}, {attribute})' if name in derived else attribute} AS {kind}) AS {name}")
    return named.withColumn("_rest", F.when(F.size(rest) > 0, rest)).selectExpr(*columns, "_rest").withColumn("unmapped", F.col("_rest")).drop("_rest")


def _attribute(name: str) -> Column:
    return F.nullif(F.col("attrs")[name], F.lit(""))


def _common(signal: str) -> dict[str, Column]:
    return {
        "otel_signal": F.lit(signal),
        "otel_scope_name": F.nullif(F.trim("scope.name"), F.lit("")),
        "otel_scope_version": F.nullif(F.trim("scope.version"), F.lit("")),
        "observer_type": F.lit("bridge"),
        "event_kind": F.lit("event"),
        "service_name": F.coalesce(_attribute("service.name"), F.lit("unknown-service")),
        "trace_id": F.lower(_text("traceId", "trace_id")),
        "span_id": F.lower(_text("spanId", "span_id")),
    }


def log_events(payloads: DataFrame, received: Column | None = None) -> DataFrame:
    """Flat event rows of log payloads."""
    now = received if received is not None else F.current_timestamp()
    rows = _attribute_map(
        _exploded(payloads, "resourceLogs", "scopeLogs", "instrumentationLibraryLogs", "logRecords"), "res", "scope.attributes", "r.attributes", body="r.body"
    )
    body = F.col("_body")
    is_text = F.col("r.body.stringValue").isNotNull()
    level = _text("severityText", "severity_text")
    derived = {
        **_common("logs"),
        "ts": nanos_to_timestamp(
            _text("timeUnixNano", "time_unix_nano", "observedTimeUnixNano", "observed_time_unix_nano"), now
        ),
        "event_action": F.coalesce(_attribute("event.action"), F.lit("otlp.log")),
        "log_level": F.lower(level),
        "severity_number": severity_number(_text("severityNumber", "severity_number"), level),
        "message": F.nullif(body, F.lit("")),
        "log_body": F.when(~is_text, body),
    }
    return _to_events(rows, derived)


def span_events(payloads: DataFrame, received: Column | None = None) -> DataFrame:
    """Flat event rows of trace payloads."""
    now = received if received is not None else F.current_timestamp()
    rows = _attribute_map(
        _exploded(payloads, "resourceSpans", "scopeSpans", "instrumentationLibrarySpans", "spans"), "res", "scope.attributes", "r.attributes"
    )
    start, end = (
        F.nullif(F.coalesce(_text(f"{edge}TimeUnixNano", f"{edge}_time_unix_nano").try_cast("bigint"), F.lit(0)), F.lit(0)) for edge in ("start", "end")
    )
    name = _text("name")
    derived = {
        **_common("traces"),
        "ts": nanos_to_timestamp(F.coalesce(start, end).cast("string"), now),
        "event_action": F.coalesce(_attribute("event.action"), name, F.lit("otlp.span")),
        "message": name,
        "span_name": name,
        "span_kind": span_kind(_text("kind")),
        "parent_id": F.lower(_text("parentSpanId", "parent_span_id")),
        "event_outcome": F.coalesce(_attribute("event.outcome"), status_outcome(F.col("r.status.code"))),
        "event_duration": F.when(end >= start, end - start),
    }
    return _to_events(rows, derived)


def read_logs(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Log payload files, one JSON document per line."""
    reader = (spark.readStream if stream else spark.read).schema(OTLP_LOGS).options(**options)
    return log_events(reader.json(path))


def read_traces(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(OTLP_TRACES).options(**options)
    return span_events(reader.json(path))
