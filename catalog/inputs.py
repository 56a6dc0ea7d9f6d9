"""Registered queries: files in several encodings, log files, panel specs, bodies of any kind, mergeable distinct counts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spanloom.operators import heavy, histogram, pricing
from spanloom.operators.normalize import normalize
from spanloom.plans import panels
from spanloom.session import scratch_path, written
from spanloom.sources import files, otlp, prices

from .core import EV, PANEL, register
from .ingest import EDGES, _payloads
from .paths import KNOWN
from .projection import AS_OF, RANGE, events, table
from .streams import HOUR

# ---------------------------------------------------------------- text trees
# One folder per encoding; the bytes of 事件 in GB18030 are written as if they were Latin-1 characters.
TREES = {
    "utf-8": ("'été 事件 ' || event_type || ' ' || (user_id % 5)", "utf-8"),
    "latin-1": ("'été à la ' || event_type || ' ' || (user_id % 5)", "iso-8859-1"),
    "gb18030": ("decode(unhex('CAC2BCFE'), 'ISO-8859-1') || ' ' || event_type || ' ' || (user_id % 5)", "iso-8859-1"),
}


@register(
    "file_tree_encodings",
    """SELECT encoding, line, count(*) AS lines FROM (SELECT 'utf-8' AS encoding, 'été 事件 ' || event_type || ' ' || (user_id % 5) AS line FROM events
    UNION ALL SELECT 'latin-1', 'été à la ' || event_type || ' ' || (user_id % 5) FROM events UNION ALL SELECT 'gb18030', '事件 ' || event_type || ' ' || (user_id % 5) FROM events) GROUP BY 1, 2""",
)
def file_tree_encodings(spark, sf):
    """Files written in three encodings and read as one tree; each names the decoder that took all of its bytes."""
    root = scratch_path(spark, "tree")
    for name, (text, encoding) in TREES.items():
        table(spark, sf, "events").selectExpr(f"{text} AS line").write.option("encoding", encoding).csv(f"{root}/{name}")
    tree = files.read_text_tree(spark, root, suffixes=(".csv",), encodings=files.LADDER).where("readable AND content <> ''")
    lines = tree.select("encoding", F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("encoding", "line").agg(F.count(F.lit(1)).alias("lines"))


# ---------------------------------------------------------------- log files
LINE = """CASE WHEN user_id % 3 = 0 THEN 'plain ' || event_type WHEN user_id % 3 = 1 THEN ''
 ELSE '{"gen_ai": {"tool": {"name": "t' || (user_id % 4) || '"}}, "event": {"action": "' || event_type || '"}}' END"""


@register(
    "file_logs",
    """SELECT CASE WHEN user_id % 3 = 0 THEN 'plain ' || event_type END AS message, CASE WHEN user_id % 3 = 2 THEN 't' || (user_id % 4) END AS tool_name,
    CASE WHEN user_id % 3 = 2 THEN event_type END AS event_action, count(*) AS rows FROM events WHERE user_id % 3 <> 1 GROUP BY 1, 2, 3""",
)
def file_logs(spark, sf):
    """Log files with plain, structured and blank lines."""
    root = scratch_path(spark, "logs")
    table(spark, sf, "events").selectExpr(f"{LINE} AS value").write.text(root)
    rows = normalize(files.read_log_files(spark, root, glob="*.txt"))
    plain = F.when(~F.col("message").startswith("{"), F.col("message"))
    return rows.groupBy(plain.alias("message"), "tool_name", "event_action").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- panels of a file
SPECS = [
    {"id": "tools", "aggregation": "terms", "field": "tool_name", "size": 4}, {"id": "retries", "aggregation": "sum", "field": "retry_count", "interval": "1 day"},
    {"id": "skipped", "aggregation": "scatter", "field": "tool_name"},
]


@register(
    "panel_specs",
    f"""{PANEL}, t AS (SELECT 'tools' AS panel, tool_name AS key, count(*) AS value FROM p WHERE tool_name IS NOT NULL GROUP BY 2 ORDER BY value DESC, key LIMIT 4)
    SELECT * FROM t UNION ALL SELECT 'retries', strftime(date_trunc('day', ts), '%Y-%m-%d'), CAST(coalesce(sum(retry_count), 0) AS BIGINT) FROM p GROUP BY 2""",
)
def panel_specs(spark, sf):
    """User panels out of a JSON file; a kind that is not known is left out."""
    path = scratch_path(spark, "panels")
    spark.createDataFrame([(json.dumps({"panels": SPECS}),)], "value string").coalesce(1).write.text(path)
    found = panels.dashboard(events(spark, sf), "1 day", RANGE, AS_OF, panels.load_specs(files.read_config(spark, path)))
    assert "skipped" not in found
    top = found["tools"].select(F.lit("tools").alias("panel"), F.col("tool_name").alias("key"), F.col("count").alias("value"))
    return top.unionByName(found["retries"].select(F.lit("retries").alias("panel"), F.date_format("bucket", "yyyy-MM-dd").alias("key"), F.col("sum").alias("value")))


# ---------------------------------------------------------------- bodies of any kind
BODIES = """CASE user_id % 5 WHEN 0 THEN '{"kvlistValue":{"values":[{"key":"b","value":{"intValue":"' || user_id || '"}},{"key":"a","value":{"arrayValue":{"values":[{"stringValue":"' || event_type || '"},{"boolValue":true}]}}}]}}'
 WHEN 1 THEN '{"arrayValue":{"values":[{"intValue":"' || user_id || '"},{"kvlistValue":{"values":[]}}]}}' WHEN 2 THEN '{"intValue":"' || user_id || '"}' WHEN 3 THEN '{"boolValue":false}' ELSE '{"stringValue":"' || event_type || '"}' END"""
BODY_PAYLOAD = f"""'{{"resourceLogs":[{{"scopeLogs":[{{"logRecords":[{{"spanId":"S' || event_id || '","body":' || {BODIES} || '}}]}}]}}]}}'"""


@register(
    "otlp_bodies",
    """SELECT span_id, message, CASE WHEN kind < 4 THEN message END AS log_body FROM (SELECT 's' || event_id AS span_id, user_id % 5 AS kind,
    CASE user_id % 5 WHEN 0 THEN '{"a": ["' || event_type || '", true], "b": ' || user_id || '}' WHEN 1 THEN '[' || user_id || ', {}]' WHEN 2 THEN '' || user_id WHEN 3 THEN 'false' ELSE event_type END AS message FROM events)""",
)
def otlp_bodies(spark, sf):
    """Log bodies that are objects, lists, numbers, booleans and texts."""
    return otlp.log_events(_payloads(spark, sf, BODY_PAYLOAD, otlp.OTLP_LOGS, "resourceLogs")).select("span_id", "message", "log_body")


# ---------------------------------------------------------------- dimensions as given
@register(
    "span_metrics_dimensions",
    f"""{EV} SELECT {HOUR}, service_name, event_outcome, count(*) AS calls, count(event_duration) AS duration_count,
    CAST(coalesce(sum(event_duration),0) AS BIGINT) AS duration_sum, CAST(coalesce(sum(retry_count),0) AS BIGINT) AS retries,
    CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS tokens_out, {EDGES} FROM ev GROUP BY 1, 2, 3""",
)
def span_metrics_dimensions(spark, sf):
    """Dimensions with blanks and repeats: each counts once, in the order given."""
    found = histogram.span_metrics(events(spark, sf), "1 hour", [" service_name", "", "event_outcome", "service_name ", "event_outcome"])
    assert found.columns[:3] == ["bucket", "service_name", "event_outcome"]
    return found


# ---------------------------------------------------------------- distinct counts that merge
LEVELS = {"day": "date_trunc('day', {ts})", "week": "date_trunc('week', {ts})", "all": "TIMESTAMP '2000-01-01 00:00:00'"}


@register(
    "distinct_roll_up",
    f"{EV} "
    + " UNION ALL ".join(
        f"SELECT '{level}' AS level, CAST({start.format(ts='ts')} AS TIMESTAMP) AS bucket, service_name, count(DISTINCT conversation_id) AS sessions, count(DISTINCT tool_name) AS tools FROM ev GROUP BY 1, 2, 3"
        for level, start in LEVELS.items()
    ),
)
def distinct_roll_up(spark, sf):
    """Sessions and tools per day, week and in all, united from hourly sketches that were stored."""
    hourly = written(histogram.distinct_sketches(events(spark, sf), "1 hour", ["conversation_id", "tool_name"], ["service_name"]), "sketches")
    parts = []
    for level, start in LEVELS.items():
        rows = hourly.withColumn("level", F.lit(level)).withColumn("bucket", F.expr(f"CAST({start.format(ts='bucket').replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')} AS TIMESTAMP_NTZ)"))
        parts.append(histogram.distinct_counts(rows, ["level", "bucket", "service_name"]))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("level", "bucket", "service_name", F.col("conversation_id").alias("sessions"), F.col("tool_name").alias("tools"))


# ---------------------------------------------------------------- the first of very many keys
WORDS = "SELECT unnest(string_split(text, ' ')) AS word FROM documents"


@register("top_words", f"SELECT word, count(*) AS count FROM ({WORDS}) WHERE word <> '' GROUP BY 1 ORDER BY count DESC, word LIMIT 25")
def top_words(spark, sf):
    """The most frequent of some hundred thousand words, without grouping them all."""
    rows = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return heavy.top_keys(rows, "word", 25)


@register("top_sessions_stored", f"{EV} SELECT conversation_id, count(*) AS count FROM ev GROUP BY 1 ORDER BY count DESC, conversation_id LIMIT 12")
def top_sessions_stored(spark, sf):
    """The busiest sessions of the whole time, from daily counters that were stored."""
    daily = written(heavy.summaries(events(spark, sf), "conversation_id", "1 day", 64), "counters")
    chosen, certain = heavy.candidates(daily, 12)
    rows = events(spark, sf)
    return heavy.verified(rows, "conversation_id", chosen, 12) if certain else heavy.top_keys(rows, "conversation_id", 12)


# ---------------------------------------------------------------- prices as a table
@register(
    "price_table",
    f"""{EV}, k(model, low, high) AS ({KNOWN}) SELECT request_model, CAST(low AS DOUBLE) AS price_in, CAST(high AS DOUBLE) AS price_out, count(*) AS calls
    FROM ev JOIN k ON k.model = request_model GROUP BY 1, 2, 3""",
)
def price_table(spark, sf):
    """Prices that are a table of 601 rows: distinct models joined on their prefixes."""
    given = {"House-Model-1": {"input": 1, "output": 2}} | {f"filler-{i}": [i, i] for i in range(600)}
    known = [(pattern, str(low), str(high)) for pattern, (low, high) in prices.prices(json.dumps(given)).items()]
    rows = spark.createDataFrame(known, "pattern string, low string, high string")
    rows = rows.selectExpr("pattern", "CAST(low AS DECIMAL(12,6)) AS price_in", "CAST(high AS DECIMAL(12,6)) AS price_out")
    priced = pricing.with_price(events(spark, sf).where("request_model IS NOT NULL"), rows)
    found = priced.groupBy("request_model", F.col("_price.price_in").cast("double").alias("price_in"), F.col("_price.price_out").cast("double").alias("price_out"))
    return found.agg(F.count(F.lit(1)).alias("calls"))
