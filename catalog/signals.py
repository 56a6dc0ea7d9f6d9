"""Registered queries: cost and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.measures import fixed
from spanloom.plans import alerts, cost
from spanloom.session import cut
from spanloom.sources.prices import DEFAULT_PRICES

from .core import EV, FAIL, NOT_INTERNAL, RECENT, fx, mean, money, register
from .projection import AS_OF, BASELINE, CURRENT, RANGE, events, table

PRICE_ROWS = "pr AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', CAST({a} AS DECIMAL(12,6)), CAST({b} AS DECIMAL(12,6)))" for name, (a, b) in DEFAULT_PRICES.items()
) + ") t(pattern, price_in, price_out))"
MODELS = f"""{EV}, {PRICE_ROWS}, md AS (SELECT DISTINCT request_model FROM ev WHERE request_model IS NOT NULL),
pm AS (SELECT request_model, pattern, price_in, price_out FROM (SELECT md.request_model, pr.*,
  row_number() OVER (PARTITION BY md.request_model ORDER BY length(pr.pattern) DESC) AS r
  FROM md JOIN pr ON starts_with(trim(lower(md.request_model)), pr.pattern)) WHERE r = 1)"""
NEEDS = f"{RECENT} AND input_tokens IS NOT NULL AND ev.request_model IS NOT NULL AND cost IS NULL"
CALL = (
    "CAST(round((CAST(coalesce(input_tokens,0) AS DECIMAL(15,0)) * price_in + CAST(coalesce(output_tokens,0) AS DECIMAL(15,0)) * price_out)"
    " * CAST(0.000001 AS DECIMAL(7,6)), 8) AS DOUBLE)"
)

register(
    "cost_price_match",
    f"""{MODELS} SELECT ev.request_model, count(*) AS calls, any_value(pm.pattern) AS pattern, CAST(any_value(pm.price_in) AS DOUBLE) AS price_in,
    CAST(any_value(pm.price_out) AS DOUBLE) AS price_out FROM ev LEFT JOIN pm ON ev.request_model = pm.request_model
    WHERE ev.request_model IS NOT NULL GROUP BY ev.request_model""",
)(lambda spark, sf: cost.price_match(events(spark, sf)))

register(
    "cost_backfill",
    f"""{MODELS} SELECT event_id, ev.request_model, CASE WHEN {NEEDS} THEN {CALL} ELSE cost END AS cost
    FROM ev LEFT JOIN pm ON ev.request_model = pm.request_model""",
)(lambda spark, sf: cost.backfill(events(spark, sf), RANGE, AS_OF).select("event_id", "request_model", "cost"))

register(
    "cost_backfill_summary",
    f"""{MODELS} SELECT trim(ev.request_model) AS model, count(*) AS total_scanned, count({CALL}) AS enriched,
    CAST(coalesce({money(CALL)}, 0) AS DOUBLE) AS cost_added FROM ev LEFT JOIN pm ON ev.request_model = pm.request_model WHERE {NEEDS} GROUP BY 1""",
)(lambda spark, sf: cost.backfill_summary(events(spark, sf), RANGE, AS_OF))

COSTED = f"{EV}, c AS (SELECT * FROM ev WHERE {RECENT} AND {NOT_INTERNAL} AND cost IS NOT NULL)"

register("cost_total", f"{COSTED} SELECT {fx(f'coalesce({money()}, 0)', 6)} AS total_cost_usd, count(cost) AS calls FROM c")(
    lambda spark, sf: cost.total_cost(events(spark, sf), RANGE, AS_OF)
)


def _cost_by(name, column, size):
    register(
        f"cost_by_{name}",
        f"{COSTED} SELECT {column} AS name, {fx(money(), 6)} AS cost, count(*) AS calls FROM c WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY {money()} DESC, 1 LIMIT {size}",
    )(lambda spark, sf: cost.cost_by(events(spark, sf), column, size, RANGE, AS_OF))


_cost_by("model", "request_model", 20)
_cost_by("tool", "tool_name", 20)
_cost_by("session", "conversation_id", 10)


def _cost_list(name, column, size):
    return f"""SELECT '{name}' AS breakdown, rank, name, {fx('cost', 6)} AS cost, calls FROM (SELECT {column} AS name, {money()} AS cost, count(*) AS calls,
    CAST(row_number() OVER (ORDER BY {money()} DESC, {column}) AS INTEGER) AS rank FROM c WHERE {column} IS NOT NULL GROUP BY {column}) WHERE rank <= {size}"""


register(
    "cost_summary",
    f"{COSTED} "
    + " UNION ALL ".join([_cost_list("by_model", "request_model", 20), _cost_list("by_tool", "tool_name", 20), _cost_list("by_session", "conversation_id", 10)]),
)(lambda spark, sf: cost.summary(events(spark, sf), RANGE, AS_OF))

# ---------------------------------------------------------------- alerts
# The baseline multiplier is low because the baseline is 29 days against two.
RULES = alerts.Rules(time_range=CURRENT, baseline_range=BASELINE, token_threshold_multiplier=0.05)
T, L, M = RULES.error_threshold, RULES.p95_latency_threshold_ms, RULES.token_threshold_multiplier
BY = ["service_name"]

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
IN_CURRENT = f"ts >= {NOW} - INTERVAL 2 DAY"
IN_BASELINE = f"ts >= {NOW} - INTERVAL 31 DAY AND ts <= {NOW} - INTERVAL 2 DAY"

SCOPES = f"""{EV}, fl AS (SELECT *, {IN_CURRENT} AS cur, ({IN_BASELINE}) AS bas FROM ev WHERE {NOT_INTERNAL}),
sc AS (SELECT 'all' AS scope, * FROM fl WHERE cur OR bas UNION ALL SELECT 'service_name=' || service_name AS scope, * FROM fl WHERE cur OR bas),
mt AS (SELECT scope, count(*) FILTER (cur) AS events, count(*) FILTER (cur AND {FAIL}) AS errors,
  CAST(coalesce(sum(coalesce(input_tokens,0) + coalesce(output_tokens,0)) FILTER (cur), 0) AS BIGINT) AS tokens,
  CAST(coalesce(sum(retry_count) FILTER (cur), 0) AS BIGINT) AS retries,
  quantile_cont(event_duration, 0.95) FILTER (cur) / 1e6 AS p95,
  count(*) FILTER (bas) AS b_events, count(*) FILTER (bas AND {FAIL}) AS b_errors,
  CAST(coalesce(sum(coalesce(input_tokens,0) + coalesce(output_tokens,0)) FILTER (bas), 0) AS BIGINT) AS b_tokens,
  CAST(coalesce(sum(retry_count) FILTER (bas), 0) AS BIGINT) AS b_retries,
  quantile_cont(event_duration, 0.95) FILTER (bas) / 1e6 AS b_p95
  FROM sc GROUP BY scope)"""


def top_list(name: str, column: str, measure: str, where: str = "true") -> str:
    """The five first keys per scope by a measure, as a CTE ``name(scope, key, v, r)``."""
    return f"""{name} AS (SELECT * FROM (SELECT scope, {column} AS key, {measure} AS v,
      row_number() OVER (PARTITION BY scope ORDER BY {measure} DESC, {column}) AS r FROM sc WHERE cur AND {column} IS NOT NULL AND {where} GROUP BY scope, {column}) WHERE r <= 5)"""


TOKENS = "coalesce(sum(input_tokens),0)"
RETRIES = "coalesce(sum(retry_count),0)"
LISTS = ", ".join(
    [
        top_list("l_types", "error_type", "count(*)"),
        top_list("l_err_tools", "tool_name", "count(*)", FAIL),
        top_list("l_err_models", "request_model", "count(*)", FAIL),
        top_list("l_fail_sess", "conversation_id", "count(*)", FAIL),
        top_list("l_fail_comp", "component_type", "count(*)", FAIL),
        top_list("l_tok_tools", "tool_name", TOKENS),
        top_list("l_tok_models", "request_model", TOKENS),
        top_list("l_tok_sess", "conversation_id", TOKENS),
        top_list("l_ret_sess", "conversation_id", RETRIES),
        top_list("l_ret_tools", "tool_name", RETRIES),
        top_list("l_lat_tools", "tool_name", "quantile_cont(event_duration, 0.95)"),
        top_list("l_turns", "turn_id", fx(mean("latency_ms"), 2)),
    ]
)
TURN_OF = """tn AS (SELECT t.scope, t.key, t.v, t.r,
  (SELECT conversation_id FROM sc WHERE cur AND sc.scope = t.scope AND sc.turn_id = t.key GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS session_id,
  (SELECT component_type FROM sc WHERE cur AND sc.scope = t.scope AND sc.turn_id = t.key GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS component_type
  FROM l_turns t)"""
BASE = f"{SCOPES}, {LISTS}, {TURN_OF}"


def first(name: str, column: str = "key") -> str:
    return f"(SELECT {column} FROM {name} x WHERE x.scope = mt.scope AND x.r = 1)"


E_RATE = fx("errors / CAST(greatest(events,1) AS DOUBLE)", 4)
B_RATE = fx("b_errors / CAST(greatest(b_events,1) AS DOUBLE)", 4)
RATIO = fx("tokens / CAST(greatest(b_tokens,1) AS DOUBLE)", 2)
SHARE = f"({first('l_fail_sess', 'v')} / CAST(greatest(errors,1) AS DOUBLE))"
MULT = "CASE WHEN b_retries <> 0 THEN retries / CAST(greatest(b_retries,1) AS DOUBLE) ELSE CAST(retries AS DOUBLE) END"
P95, B95 = "coalesce(p95, 0)", "coalesce(b_p95, 0)"
HOT_RETRY = f"coalesce({first('l_ret_sess', 'v')}, 0)"
TURN_MS = first("tn", "v")

FIRED = {
    "error_rate_spike": f"errors >= {T}",
    "token_consumption_anomaly": f"b_tokens > 0 AND tokens > b_tokens * CAST({M} AS DOUBLE)",
    "latency_degradation": f"{P95} >= {L}",
    "session_failure_hotspot": f"coalesce({first('l_fail_sess', 'v')} >= 5 AND {SHARE} >= 0.35, false)",
    "retry_storm": f"{first('l_ret_sess')} IS NOT NULL AND NOT ({HOT_RETRY} < 5 AND retries < 10)",
    "long_turn_hotspot": f"coalesce({TURN_MS} >= greatest(1000.0, {L} * 0.6), false)",
}
SEVERE = {
    "error_rate_spike": f"{E_RATE} > 0.5",
    "token_consumption_anomaly": f"{RATIO} >= 5",
    "latency_degradation": f"{P95} >= {2 * L}",
    "session_failure_hotspot": f"{SHARE} >= 0.6",
    "retry_storm": f"{HOT_RETRY} >= {max(10, T)}",
    "long_turn_hotspot": f"{TURN_MS} >= {1.5 * L}",
}


def state(kind: str) -> str:
    return f"""({FIRED[kind]}) AS fired, CASE WHEN {FIRED[kind]} THEN CASE WHEN {SEVERE[kind]} THEN 'critical' ELSE 'warning' END END AS severity"""


OUTPUT = {
    "error_rate_spike": {
        "error_count": "errors", "error_rate": E_RATE, "baseline_rate": B_RATE, "primary_type": first("l_types"),
        "primary_tool": first("l_err_tools"), "primary_model": first("l_err_models"), "primary_session": first("l_fail_sess"),
    },
    "token_consumption_anomaly": {
        "current_tokens": "tokens", "baseline_tokens": "b_tokens", "ratio": RATIO, "primary_tool": first("l_tok_tools"),
        "primary_model": first("l_tok_models"), "primary_session": f"coalesce({first('l_tok_sess')}, {first('l_ret_sess')})",
        "primary_session_source": f"CASE WHEN {first('l_tok_sess')} IS NOT NULL THEN 'token' WHEN {first('l_ret_sess')} IS NOT NULL THEN 'retry_fallback' ELSE 'none' END",
    },
    "latency_degradation": {
        "p95_ms": fx(P95, 1), "baseline_p95_ms": fx(B95, 1), "threshold_ms": f"CAST({L} AS DOUBLE)", "primary_tool": first("l_lat_tools"),
        "primary_turn": first("tn"), "primary_session": first("tn", "session_id"),
    },
    "session_failure_hotspot": {
        "total_failures": "errors", "session_failures": f"CAST({first('l_fail_sess', 'v')} AS BIGINT)", "concentration": fx(SHARE, 4),
        "primary_session": first("l_fail_sess"), "primary_component": first("l_fail_comp"),
    },
    "retry_storm": {
        "total_retries": "retries", "baseline_retries": "b_retries", "baseline_multiplier": fx(MULT, 2),
        "primary_session": first("l_ret_sess"), "primary_tool": first("l_ret_tools"),
    },
    "long_turn_hotspot": {
        "turn_latency_ms": TURN_MS, "threshold_ms": f"CAST({L} AS DOUBLE)", "primary_turn": first("tn"),
        "primary_session": first("tn", "session_id"), "primary_component": first("tn", "component_type"),
    },
}
SHORT = {
    "error_rate_spike": "error_spike", "token_consumption_anomaly": "token_anomaly", "latency_degradation": "latency",
    "session_failure_hotspot": "session_hotspot", "retry_storm": "retry_storm", "long_turn_hotspot": "long_turn",
}


def _found(spark, sf, fired_only=False, only=()):
    return alerts.alerts(events(spark, sf), RULES, AS_OF, BY, fired_only, only=only)


def _named(name, sql):
    """What has no key is called unknown."""
    return f"coalesce({sql}, 'unknown')" if name.startswith("primary_") else sql


def _alert(kind):
    outputs = OUTPUT[kind]
    register(
        f"alert_{SHORT[kind]}",
        f"{BASE} SELECT scope, {state(kind)}, " + ", ".join(f"{_named(name, sql)} AS {name}" for name, sql in outputs.items()) + " FROM mt",
    )(
        lambda spark, sf: _found(spark, sf, only=[kind]).select("scope", "fired", "severity", *outputs)
    )


for _kind in OUTPUT:
    _alert(_kind)

CAP = "least(1.0, {0})"
SCORE = {
    "error_rate_spike": f"0.3 + CASE WHEN {B_RATE} > 0 THEN least(0.35, greatest(0.0, ({E_RATE} - {B_RATE}) / {B_RATE} / 5.0)) ELSE 0.0 END",
    "token_consumption_anomaly": f"0.3 + CASE WHEN {RATIO} > 1 THEN least(0.3, ({RATIO} - 1) / 10.0) ELSE 0.0 END",
    "latency_degradation": f"0.3 + least(0.3, greatest(0.0, ({fx(P95, 1)} - {L}) / ({L} * 3)))",
    "session_failure_hotspot": f"0.3 + least(0.3, {fx(SHARE, 4)} * 0.5)",
    "retry_storm": f"0.3 + CASE WHEN {fx(MULT, 2)} > 1 THEN least(0.3, ({fx(MULT, 2)} - 1) / 10.0) ELSE 0.0 END",
    "long_turn_hotspot": "0.3",
}
SIGNALS = {
    "error_rate_spike": ("l_err_tools", "l_err_models", "l_fail_sess"),
    "token_consumption_anomaly": ("l_tok_tools", "l_tok_models", "l_ret_sess"),
    "latency_degradation": ("l_lat_tools", "tn"),
    "session_failure_hotspot": ("l_fail_sess", "l_fail_comp"),
    "retry_storm": ("l_ret_sess",),
    "long_turn_hotspot": ("tn",),
}


def _confidence(kind):
    lists = " + ".join(f"CASE WHEN {first(n)} IS NOT NULL THEN 1 ELSE 0 END" for n in SIGNALS[kind])
    score = CAP.format(f"CAST({SCORE[kind]} AS DOUBLE) + least(0.15, ({lists}) * 0.03)")
    return f"SELECT scope, '{kind}' AS alert_type, {state(kind)}, {fx(score, 2)} AS confidence FROM mt"


CONFIDENCE = " UNION ALL ".join(_confidence(kind) for kind in OUTPUT)
register("alert_confidence", f"{BASE} SELECT scope, alert_type, severity, confidence FROM ({CONFIDENCE}) WHERE fired")(
    lambda spark, sf: _found(spark, sf, True).select("scope", "alert_type", "severity", "confidence")
)

ENTITY = {
    "error_rate_spike": {"l_err_tools": "tool", "l_err_models": "model", "l_fail_sess": "session"},
    "token_consumption_anomaly": {"l_tok_tools": "tool", "l_tok_models": "model", "l_tok_sess": "session", "l_ret_sess": "session"},
    "latency_degradation": {"l_lat_tools": "tool", "tn": "turn", "tn.session_id": "session", "tn.component_type": "component"},
    "session_failure_hotspot": {"l_fail_sess": "session", "l_fail_comp": "component"},
    "retry_storm": {"l_ret_sess": "session", "l_ret_tools": "tool"},
    "long_turn_hotspot": {"tn": "turn", "tn.session_id": "session", "tn.component_type": "component"},
}


def _entities():
    parts = []
    for kind, lists in ENTITY.items():
        for name, what in lists.items():
            source, _, column = name.partition(".")
            parts.append(
                f"SELECT x.scope, '{kind}' AS alert_type, '{what}' AS kind, trim(x.{column or 'key'}) AS key FROM {source} x JOIN st ON st.scope = x.scope AND st.alert_type = '{kind}'"
            )
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ") WHERE key IS NOT NULL AND key NOT IN ('', 'unknown')"


STATES = f"st AS (SELECT * FROM ({CONFIDENCE}) WHERE fired), en AS ({_entities()})"
register("alert_entities", f"{BASE}, {STATES} SELECT scope, alert_type, kind, key FROM en")(
    lambda spark, sf: alerts.entities(_found(spark, sf, True))
)

ORDER = "CASE alert_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(OUTPUT)) + " END"
CHAINS = f"""{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {STATES},
ed AS (SELECT DISTINCT a.scope, a.alert_type AS x, b.alert_type AS y FROM en a JOIN en b ON a.scope = b.scope AND a.kind = b.kind AND a.key = b.key),
rc AS (SELECT scope, x AS start, y AS seen FROM ed UNION SELECT rc.scope, rc.start, ed.y FROM rc JOIN ed ON ed.scope = rc.scope AND ed.x = rc.seen),
cp AS (SELECT scope, start AS alert_type, min({ORDER.replace('alert_type', 'seen')}) AS label FROM rc GROUP BY 1, 2),
mb AS (SELECT cp.scope, cp.label, st.alert_type, st.severity, st.confidence, CASE severity WHEN 'critical' THEN 0 ELSE 1 END * 10 + {ORDER.replace('alert_type', 'st.alert_type')} AS o
  FROM cp JOIN st ON st.scope = cp.scope AND st.alert_type = cp.alert_type),
sz AS (SELECT scope, label, count(*) AS n FROM mb GROUP BY scope, label),
sh AS (SELECT mb.scope, mb.label, en.kind, en.key FROM mb JOIN en ON en.scope = mb.scope AND en.alert_type = mb.alert_type
  JOIN sz ON sz.scope = mb.scope AND sz.label = mb.label
  GROUP BY mb.scope, mb.label, en.kind, en.key, sz.n HAVING count(DISTINCT mb.alert_type) = sz.n)
SELECT mb.scope, CAST(count(*) AS INTEGER) AS members, string_agg(alert_type, ' -> ' ORDER BY o) AS narrative, max(confidence) AS confidence,
  coalesce((SELECT string_agg(kind || ':' || key, ',' ORDER BY kind, key) FROM sh WHERE sh.scope = mb.scope AND sh.label = mb.label), '') AS shared
FROM mb GROUP BY mb.scope, mb.label HAVING count(*) > 1"""


@register("alert_chains", CHAINS)
def alert_chains(spark, sf):
    out = alerts.chains(_found(spark, sf, True))
    shared = F.array_join(F.expr("array_sort(transform(shared_entities, e -> concat(e.kind, ':', e.key)))"), ",")
    return out.select("scope", "members", "narrative", "confidence", shared.alias("shared"))


@register(
    "alert_event_rows",
    f"""{BASE}, {STATES} SELECT scope, alert_type AS event_action, 'failure' AS event_outcome, severity AS alert_severity FROM st
    UNION ALL SELECT scope, 'alert_check_ok', 'success', NULL FROM mt WHERE scope NOT IN (SELECT scope FROM st)""",
)
def alert_event_rows(spark, sf):
    wide = cut(alerts.snapshot(events(spark, sf), RULES, AS_OF, BY))
    rows = alerts.alert_events(alerts.analyze(wide), wide, F.lit(AS_OF).cast("timestamp"))
    return rows.select("scope", "event_action", "event_outcome", "alert_severity")


EVIDENCE = {
    "top_error_types": ("error_type", "count(*)", "true"), "top_error_tools": ("tool_name", "count(*)", FAIL), "top_error_models": ("request_model", "count(*)", FAIL),
    "top_failure_sessions": ("conversation_id", "count(*)", FAIL), "top_failure_components": ("component_type", "count(*)", FAIL),
    "top_tools": ("tool_name", TOKENS, "true"), "top_models": ("request_model", TOKENS, "true"), "top_token_sessions": ("conversation_id", TOKENS, "true"),
    "top_retry_sessions": ("conversation_id", RETRIES, "true"), "top_retry_tools": ("tool_name", RETRIES, "true"),
    "top_latency_tools": ("tool_name", "quantile_cont(event_duration, 0.95) / 1e6", "true"), "top_turns": ("turn_id", fx(mean("latency_ms"), 2), "true"),
}


def _evidence(name):
    column, measure, where = EVIDENCE[name]
    return f"""SELECT scope, '{name}' AS list, rank, key, count, {fx('value', 4)} AS value FROM (SELECT scope, {column} AS key, count(*) AS count, CAST({measure} AS DOUBLE) AS value,
    CAST(row_number() OVER (PARTITION BY scope ORDER BY {measure} DESC, {column}) AS INTEGER) AS rank FROM sc WHERE cur AND {column} IS NOT NULL AND {where} GROUP BY scope, {column}) WHERE rank <= 5"""


@register("alert_evidence", f"{SCOPES} " + " UNION ALL ".join(_evidence(n) for n in EVIDENCE))
def alert_evidence(spark, sf):
    rows = alerts.evidence_rows(alerts.snapshot(events(spark, sf), RULES, AS_OF, BY))
    return rows.withColumn("value", fixed(F.col("value"), 4))


register(
    "alert_overrides",
    f"""{SCOPES}, o AS (SELECT 'service_name=svc-' || (user_id % 4) AS scope, CAST(floor(count(*) FILTER (event_type = 'error') / 20) AS INTEGER) AS t FROM events WHERE user_id % 4 <> 3 GROUP BY 1)
    SELECT mt.scope, errors AS error_count FROM mt LEFT JOIN o ON o.scope = mt.scope WHERE errors >= coalesce(t, {T})""",
)(lambda spark, sf: _with_overrides(spark, sf))


def _with_overrides(spark, sf):
    """Each service's own error threshold: a twentieth of its errors; svc-3 and the whole keep the default."""
    own = spark.sql(
        "SELECT 'service_name=svc-' || (user_id % 4) AS scope, CAST(floor(count_if(event_type = 'error') / 20) AS INT) AS error_threshold, CAST(NULL AS DOUBLE) AS p95_latency_threshold_ms, "
        "CAST(NULL AS DOUBLE) AS token_threshold_multiplier FROM {events} WHERE user_id % 4 <> 3 GROUP BY 1",
        events=table(spark, sf, "events"),
    )
    wide = alerts.override(alerts.snapshot(events(spark, sf), RULES, AS_OF, BY, only=["error_rate_spike"]), own)
    return alerts.analyze(wide, True, ["error_rate_spike"]).select("scope", "error_count")
