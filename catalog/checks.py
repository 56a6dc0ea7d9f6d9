"""Registered queries: health, canaries, retention, drift and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import drift
from spanloom.plans import discovery, health
from spanloom.schema import COVERAGE_TIERS, DOTTED

from .core import EV, NOT_INTERNAL, fx, register
from .projection import AS_OF, events, table
from .signals import NOW

MINUTES = 31 * 24 * 60
REAL = f"{EV}, r AS (SELECT * FROM ev WHERE {NOT_INTERNAL} AND ts >= {NOW} - INTERVAL 31 DAY)"
# a service is stale when its last day is quiet
DAY = 24 * 60

register("health_freshness", f"{REAL} SELECT CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS status, count(*) AS doc_count, max(ts) AS last_seen FROM r")(
    lambda spark, sf: health.freshness(events(spark, sf), MINUTES, AS_OF)
)
register(
    "health_freshness_by_service",
    f"""{EV}, c AS (SELECT service_name, count(*) FILTER (ts >= {NOW} - INTERVAL 1 DAY) AS doc_count, max(ts) AS last_seen FROM ev WHERE {NOT_INTERNAL} GROUP BY 1)
    SELECT *, CASE WHEN doc_count > 0 THEN 'pass' ELSE 'fail' END AS status FROM c""",
)(lambda spark, sf: health.freshness_by_service(events(spark, sf), DAY, AS_OF, "now-31d"))
register("health_top_services", f"{REAL} SELECT service_name, count(*) AS count FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")(
    lambda spark, sf: health.top_services(events(spark, sf), MINUTES, AS_OF)
)


def _field(name, tier):
    return f"SELECT service_name, '{DOTTED[name]}' AS field, {tier} AS tier, count({name}) AS doc_count, count(*) AS total FROM r GROUP BY service_name"


FIELDS = " UNION ALL ".join(_field(n, t) for n, t in COVERAGE_TIERS.items())
COVERAGE = f"SELECT service_name, field, tier, doc_count, total, {fx('doc_count / CAST(total AS DOUBLE)', 3)} AS coverage, doc_count > 0 AS present FROM ({FIELDS})"
register("health_coverage", f"{REAL} {COVERAGE}")(lambda spark, sf: health.coverage(events(spark, sf), MINUTES, AS_OF, ["service_name"]))
SCORE = f"""SELECT service_name, max(total) AS total_docs, {fx("sum(CASE WHEN present THEN CASE tier WHEN 2 THEN 2 ELSE 1 END ELSE 0 END) / CAST(sum(CASE tier WHEN 2 THEN 2 ELSE 1 END) AS DOUBLE)", 2)} AS score,
 count(*) FILTER (NOT present AND tier = 2) AS tier2_missing, count(*) FILTER (NOT present AND tier = 3) AS tier3_missing,
 CASE WHEN count(*) FILTER (NOT present AND tier = 2) > 0 THEN 'warn' ELSE 'pass' END AS status FROM ({COVERAGE}) GROUP BY 1"""
register("health_coverage_score", f"{REAL} {SCORE}")(
    lambda spark, sf: health.coverage_score(health.coverage(events(spark, sf), MINUTES, AS_OF, ["service_name"]), ["service_name"])
)

# Every event stands for one sent canary; the k value decides what became of it.
SENT = """SELECT 'c-' || event_id AS verify_id, k % 11 <> 0 AS send_ok, CASE WHEN k % 22 = 0 THEN NULL ELSE 503 END AS status_code FROM {b}"""
LANDED = """SELECT 'c-' || event_id AS verify_id, ts, CASE WHEN k % 13 <> 0 THEN 'internal.pipeline_verify' END AS event_dataset,
 CASE WHEN k % 17 <> 0 THEN 'svc' END AS service_name FROM {b} WHERE k % 7 <> 0"""
BASE = "SELECT event_id, ts, CAST({json} AS INT) AS k FROM {events}"


def _base(spark, sf):
    return spark.sql(BASE.replace("{json}", "get_json_object(props, '$.k')"), events=table(spark, sf, "events"))


DUCK_BASE = BASE.replace("{json}", "json_extract_string(props, '$.k')").replace("{events}", "events")
CANARY = f"""WITH b AS ({DUCK_BASE}), s AS ({SENT.replace('{b}', 'b')}), l AS ({LANDED.replace('{b}', 'b')}),
j AS (SELECT s.*, l.verify_id IS NOT NULL AS landed, coalesce(event_dataset = 'internal.pipeline_verify', false) AS d, service_name IS NOT NULL AS n FROM s LEFT JOIN l ON s.verify_id = l.verify_id)
SELECT verify_id, CASE WHEN NOT send_ok THEN CASE WHEN status_code IS NULL THEN 'transport_unreachable' ELSE 'transport_rejected' END
 WHEN landed AND d AND n THEN 'ok' WHEN landed THEN 'contract_broken' ELSE 'sent_but_lost' END AS verdict,
 CASE WHEN send_ok AND landed THEN concat_ws(', ', CASE WHEN NOT d THEN 'event.dataset' END, CASE WHEN NOT n THEN 'service.name' END) END AS missing FROM j"""


def _canaries(spark, sf):
    base = _base(spark, sf)
    return health.canaries(spark.sql(SENT, b=base), spark.sql(LANDED, b=base))


register("canary_reconcile", CANARY)(_canaries)
register("canary_summary", f"SELECT verdict, count(*) AS canaries FROM ({CANARY}) GROUP BY 1")(
    lambda spark, sf: health.canary_summary(_canaries(spark, sf))
)

# Checks per hour, derived from what happened in it.


def _checks_sql(hour, source):
    return f"""WITH h AS (SELECT {hour} AS scope, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS e, count(CASE WHEN event_type = 'signup' THEN 1 END) AS g, count(CASE WHEN event_type = 'view' THEN 1 END) AS v FROM {source} GROUP BY 1)
    SELECT scope, 'recent_data' AS check, CASE WHEN v % 13 = 12 THEN 'unreachable' WHEN n % 9 = 0 THEN 'fail' ELSE 'pass' END AS status FROM h
    UNION ALL SELECT scope, 'canary', CASE WHEN e % 7 = 6 THEN 'fail' WHEN e % 2 = 0 THEN 'skipped' ELSE 'pass' END FROM h
    UNION ALL SELECT scope, 'processes_and_ports', CASE WHEN g % 3 = 1 THEN 'warn' ELSE 'pass' END FROM h
    UNION ALL SELECT scope, 'bridge', 'up' FROM h
    UNION ALL SELECT scope, 'collector', CASE WHEN g % 4 = 1 THEN 'down' ELSE 'up' END FROM h
    UNION ALL SELECT scope, 'instrumentation_coverage', 'warn' FROM h"""


DUCK_CHECKS = _checks_sql("strftime(ts, '%Y-%m-%d %H')", "events")


@register(
    "health_verdict",
    f"""WITH c AS ({DUCK_CHECKS}), p AS (SELECT scope, max(status) FILTER (c.check = 'recent_data') AS recent, max(status) FILTER (c.check = 'canary') AS canary,
    max(status) FILTER (c.check = 'processes_and_ports') AS proc, max(status) FILTER (c.check = 'collector') AS collector FROM c GROUP BY 1)
    SELECT scope, CASE WHEN recent = 'unreachable' THEN 'unreachable' WHEN 'fail' IN (recent, canary, proc) THEN 'broken'
    WHEN collector = 'down' AND recent = 'pass' THEN 'degraded_collector_path' WHEN proc = 'warn' THEN 'degraded' ELSE 'healthy' END AS verdict FROM p""",
)
def health_verdict(spark, sf):
    checks = spark.sql(_checks_sql("date_format(ts, 'yyyy-MM-dd HH')", "{events}"), events=table(spark, sf, "events"))
    return health.verdict(checks)


register(
    "retention_tiers",
    f"""{EV} SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS INTEGER) AS age_days,
    CASE WHEN age_days >= 20 THEN 'delete' WHEN age_days >= 10 THEN 'cold' WHEN age_days >= 4 THEN 'warm' ELSE 'hot' END AS tier FROM ev GROUP BY 1""",
)(lambda spark, sf: health.retention(events(spark, sf), 20, AS_OF))

# ---------------------------------------------------------------- drift
# Each event is a declared document; the live one differs by rules over its columns.
LOCAL = """'{"settings": {"type": "' || event_type || '", "user": ' || user_id || ', "days": [1, 2, ' || (user_id % 5) || ']}, "extra": {"a": {"b": 1}}, "meta": {"v": 1.0}}'"""
REMOTE = """'{"settings": {"type": "' || CASE WHEN user_id % 3 = 0 THEN 'other' ELSE event_type END || '", "user": ' || user_id || ', "days": ' || CASE WHEN user_id % 4 = 1 THEN '[1, 3]' ELSE '[1, 2, ' || (user_id % 5) || ']' END || ', "live_only": true}'
 || CASE WHEN user_id % 5 = 2 THEN '' ELSE ', "extra": ' || CASE WHEN user_id % 7 = 3 THEN '"text"' ELSE '{"a": {"b": 1}}' END END || ', "meta": {"v": 1}}'"""


def _documents(spark, sf, body, where="true"):
    return table(spark, sf, "events").where(where).selectExpr("'doc-' || event_id AS asset", f"{body} AS body")


DRIFT = """SELECT 'doc-' || event_id AS asset, 'settings.type' AS path, 'value_mismatch' AS type, '"' || event_type || '"' AS local, '"other"' AS remote FROM events WHERE user_id % 3 = 0
UNION ALL SELECT 'doc-' || event_id, 'settings.days', 'list_length_mismatch', '3', '2' FROM events WHERE user_id % 4 = 1
UNION ALL SELECT 'doc-' || event_id, 'settings.days[1]', 'value_mismatch', '2', '3' FROM events WHERE user_id % 4 = 1
UNION ALL SELECT 'doc-' || event_id, 'extra', 'missing_in_remote', '{"a":{"b":1}}', NULL FROM events WHERE user_id % 5 = 2
UNION ALL SELECT 'doc-' || event_id, 'extra', 'value_mismatch', '{"a":{"b":1}}', '"text"' FROM events WHERE user_id % 5 <> 2 AND user_id % 7 = 3"""

register("config_drift", DRIFT)(lambda spark, sf: drift.drift(_documents(spark, sf, LOCAL), _documents(spark, sf, REMOTE)))
register(
    "config_drift_status",
    f"""WITH d AS (SELECT asset, count(*) AS n FROM ({DRIFT}) GROUP BY 1) SELECT 'doc-' || event_id AS asset, CASE WHEN event_type = 'signup' THEN 0 ELSE coalesce(n, 0) END AS diff_count,
    CASE WHEN event_type = 'signup' THEN 'not_found' WHEN n > 0 THEN 'drifted' ELSE 'in_sync' END AS status FROM events LEFT JOIN d ON d.asset = 'doc-' || event_id""",
)(lambda spark, sf: _status(spark, sf))


def _status(spark, sf):
    # documents of sign-ups are declared but not live
    out = drift.drift_status(_documents(spark, sf, LOCAL), _documents(spark, sf, REMOTE, "event_type <> 'signup'"))
    return out


# ---------------------------------------------------------------- discovery
RULES = discovery.load_rules(
    {
        "agent_manifest": {"priority": 100, "path_keywords": ["src1"], "content_keywords": ["license"], "signals": ["runs", "errors"]},
        "runtime_entrypoint": {"priority": 98, "path_keywords": ["en/"], "content_keywords": ["the", "token"], "signals": ["runs", "latency"]},
        "tool_registry": {"priority": 92, "path_keywords": ["src2", "de/"], "content_keywords": ["der", "und die"], "signals": ["tool_calls", "tool_errors"]},
        "model_adapter": {"priority": 90, "path_keywords": ["fr/"], "content_keywords": ["les", "pour", "aux."], "signals": ["token_usage", "cost"]},
        "existing_observability": {"priority": 78, "path_keywords": ["7.txt"], "content_keywords": ["que", "est_"], "signals": ["otlp_ingest"]},
    }
)


def _files(spark, sf):
    return table(spark, sf, "documents").selectExpr("source AS workspace", "lang || '/' || source || '/' || doc_id || '.txt' AS path", "text AS content")


def _keyword(keyword):
    if any(c in keyword for c in " (_/.-"):
        return f"contains(t, '{keyword}')"
    return f"regexp_matches(t, '(^|[^a-z0-9_]){keyword}($|[^a-z0-9_])')"


def _points(kind, rule):
    parts = [f"CASE WHEN contains(path, '{k}') THEN 5 ELSE 0 END" for k in rule["path_keywords"]]
    parts += [f"CASE WHEN {_keyword(k)} THEN 3 ELSE 0 END" for k in rule["content_keywords"]]
    return f"SELECT workspace, path, '{kind}' AS module_kind, {' + '.join(parts)} AS score FROM d"


SCORES = r"""d AS (SELECT source AS workspace, lang || '/' || source || '/' || doc_id || '.txt' AS path, lower(array_to_string([y for y in [trim(regexp_replace(x, '\s+', ' ', 'g'))
 for x in string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))] if y <> ''], chr(10))) AS t FROM documents),
sc AS (SELECT * FROM (""" + " UNION ALL ".join(_points(k, r) for k, r in RULES.items()) + ") WHERE score > 0)"

register("rule_score", f"WITH {SCORES} SELECT * FROM sc")(lambda spark, sf: discovery.file_scores(_files(spark, sf), RULES))

SIGNALS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {r['priority']} AS priority, {r['signals']} AS signals" for k, r in RULES.items())
MODULES = f"""{SCORES}, ru AS ({SIGNALS}), mo AS (SELECT workspace, module_kind, CAST(sum(score) AS BIGINT) AS score, count(DISTINCT path) AS evidence_files FROM sc GROUP BY 1, 2),
pf AS (SELECT workspace, list_distinct(list(module_kind)) AS kinds, list_distinct(flatten(list(signals))) AS signals FROM mo JOIN ru ON ru.kind = mo.module_kind GROUP BY 1)"""


@register(
    "discovered_modules",
    f"WITH {MODULES} SELECT workspace, module_kind, score, evidence_files, priority, array_to_string(signals, ',') AS signals FROM mo JOIN ru ON ru.kind = mo.module_kind",
)
def discovered_modules(spark, sf):
    out = discovery.monitoring_plan(discovery.modules(_files(spark, sf), RULES))
    return out.select("workspace", "module_kind", "score", "evidence_files", "priority", F.array_join("signals", ",").alias("signals"))


def _profile(spark, sf):
    return discovery.profile(discovery.modules(_files(spark, sf), RULES))


def _has(column, *names):
    return f"list_has_any({column}, {list(names)})"


def _dimension(name):
    cap, parts = discovery.MATURITY[name]
    total = " + ".join(f"CASE WHEN {_has('kinds', *k) if k else _has('signals', *s)} THEN {worth} ELSE 0 END" for worth, k, s in parts)
    return f"least({cap}, {total})"


DIMENSIONS = {name: _dimension(name) for name in discovery.MATURITY}
DIMENSIONS["depth_bonus"] = "CAST(least(15, least(10, len(signals))) AS INTEGER)"
TOTAL = " + ".join(f"({sql})" for sql in DIMENSIONS.values())
register(
    "maturity",
    f"""WITH {MODULES} SELECT workspace, CAST({TOTAL} AS INTEGER) AS score, CASE WHEN {TOTAL} >= 80 THEN 'advanced' WHEN {TOTAL} >= 50 THEN 'intermediate' WHEN {TOTAL} >= 25 THEN 'basic' ELSE 'minimal' END AS level, """
    + ", ".join(f"CAST({sql} AS INTEGER) AS {name}" for name, sql in DIMENSIONS.items())
    + " FROM pf",
)(lambda spark, sf: discovery.maturity(_profile(spark, sf)))

MODES = " UNION ALL ".join(
    f"SELECT workspace, '{mode}' AS mode, CAST({score} AS DOUBLE) AS score FROM pf WHERE "
    + (" OR ".join(filter(None, [_has("kinds", *k) if k else "", _has("signals", *s) if s else ""])) or "true")
    for mode, score, k, s in discovery.INGEST_MODES
)
register("ingest_modes", f"WITH {MODULES} {MODES}")(lambda spark, sf: discovery.ingest_modes(_profile(spark, sf)))

register(
    "architecture_style",
    f"""WITH {MODULES} SELECT workspace, CASE WHEN {_has('kinds', 'workflow_orchestrator')} AND {_has('kinds', 'tool_registry')} THEN 'multi-stage orchestrated agent' ELSE 'mixed agent workspace' END AS architecture_style FROM pf""",
)(lambda spark, sf: discovery.architecture_style(_profile(spark, sf)).select("workspace", "architecture_style"))

# Words of the invented prose stand in for package names.
SIGNATURES = {"alpha": (("license",), ("the",)), "beta": (("token",), ("les",)), "gamma": (("der",), ("der",)), "delta": (("que",), ("que",))}
PATHS = "CASE doc_id % 3 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'lib/' || doc_id || '.py' ELSE 'setup.cfg' END"


def _match(tests):
    return "CASE " + " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(tests)) + " END"


IN_MANIFEST = _match([" OR ".join(f"contains(lower(text), '{p}')" for p in s[0]) for s in SIGNATURES.values()])
IN_IMPORTS = _match([" OR ".join(f"contains(text, 'import {p}') OR contains(text, 'from {p}')" for p in s[1]) for s in SIGNATURES.values()])
NAMES = "[" + ", ".join(f"'{n}'" for n in SIGNATURES) + "]"
register(
    "framework_detect",
    f"""WITH f AS (SELECT lang || '-' || source || '-' || (doc_id % 40) AS workspace, {PATHS} AS path, text FROM documents),
    p AS (SELECT workspace, CASE WHEN path LIKE '%.py' THEN 3 ELSE 1 END AS stage, CASE path WHEN 'requirements.txt' THEN '1' WHEN 'setup.cfg' THEN '3' ELSE path END AS file,
      CASE WHEN path LIKE '%.py' THEN {IN_IMPORTS} ELSE {IN_MANIFEST} END AS hit FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY stage, file, hit) AS n FROM p WHERE hit IS NOT NULL)
    SELECT workspace, {NAMES}[hit + 1] AS framework, stage FROM r WHERE n = 1""",
)(
    lambda spark, sf: discovery.frameworks(
        table(spark, sf, "documents").selectExpr("lang || '-' || source || '-' || (doc_id % 40) AS workspace", f"{PATHS} AS path", "text AS content"), SIGNATURES
    )
)


# Source files written from the events: one handler per event type and user group.
CODE = """'import x' || chr(10) || 'def cmd_' || event_type || '_' || CAST(user_id % 9 AS VARCHAR(9)) || ' (a):' || chr(10) || '  def helper(): pass' || chr(10) || 'def  cmd_all(): pass'"""


def _code(spark, sf):
    text = CODE.replace("VARCHAR(9)", "STRING")
    return table(spark, sf, "events").selectExpr("'w' || user_id % 7 AS workspace", "event_id || '.py' AS path", f"{text} AS content")


register(
    "command_handlers",
    """SELECT 'w' || user_id % 7 AS workspace, event_id || '.py' AS path, 'cmd_' || event_type || '_' || user_id % 9 AS handler FROM events
    UNION ALL SELECT 'w' || user_id % 7, event_id || '.py', 'cmd_all' FROM events""",
)(lambda spark, sf: discovery.command_handlers(_code(spark, sf)))

HANDLED = "SELECT 'w' || user_id % 7 AS workspace, count(*) * 8 AS score, count(*) AS evidence_files, count(DISTINCT event_type || user_id % 9) + 1 AS handlers FROM events GROUP BY 1"
register("command_modules", f"SELECT workspace, '{discovery.HANDLERS}' AS module_kind, score, evidence_files, handlers, {discovery.HANDLER_PRIORITY} AS priority FROM ({HANDLED})")(
    lambda spark, sf: discovery.modules(_code(spark, sf), RULES)
    .where(F.col("module_kind") == discovery.HANDLERS)
    .select("workspace", "module_kind", "score", "evidence_files", "handlers", "priority")
)
