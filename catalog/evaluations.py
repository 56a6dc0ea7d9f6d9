"""Registered queries: evaluators and judge rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.measures import fixed
from spanloom.plans import evaluate

from .core import EV, FAIL, NOT_INTERNAL, fx, money, register
from .projection import AS_OF, events, table
from .signals import BY, IN_BASELINE, IN_CURRENT, NOW

# Two days against the month before, so that the whole table is read.
TIME, BEFORE = "now-2d", "now-31d/now-2d"


def _side(prefix, flag):
    return f"""count(*) FILTER ({flag}) AS {prefix}total, count(*) FILTER ({flag} AND {FAIL}) AS {prefix}errors,
  coalesce(sum(coalesce(input_tokens,0) + coalesce(output_tokens,0)) FILTER ({flag}), 0) AS {prefix}tokens,
  CAST(coalesce({money()} FILTER ({flag}), 0) AS DOUBLE) AS {prefix}cost,
  count(DISTINCT conversation_id) FILTER ({flag}) AS {prefix}sessions,
  coalesce(quantile_cont(event_duration, 0.95) FILTER ({flag}) / 1e6, 0) AS {prefix}p95,
  count(*) FILTER ({flag} AND guardrail_action IS NOT NULL) AS {prefix}guarded,
  count(*) FILTER ({flag} AND guardrail_action IN ('block','redact')) AS {prefix}blocked,
  count(DISTINCT tool_name) FILTER ({flag}) AS {prefix}tools"""


BASE = f"""{EV}, fl AS (SELECT *, ({IN_CURRENT} AND ts <= {NOW}) AS cur, ({IN_BASELINE}) AS bas FROM ev WHERE {NOT_INTERNAL}),
sc AS (SELECT 'all' AS scope, * FROM fl WHERE cur OR bas UNION ALL SELECT 'service_name=' || service_name AS scope, * FROM fl WHERE cur OR bas),
mt AS (SELECT scope, {_side('', 'cur')}, {_side('b_', 'bas')}, count(DISTINCT tool_name) AS known FROM sc GROUP BY scope)"""


def _ratio(now, before, threshold, fall):
    r = f"({now}) / ({before})"
    score = f"CASE WHEN ({before}) <= 0 THEN 1.0 WHEN {r} > {threshold} THEN greatest(0.0, 1 - ({r} - 1) / {fall}) ELSE least(1.0, 1 / greatest(0.1, {r})) END"
    return (
        f"CASE WHEN ({before}) > 0 AND {r} > {threshold} THEN 'fail' ELSE 'pass' END",
        fx(score, 2),
        f"CASE WHEN ({before}) > 0 THEN {fx(r, 6)} END",
    )


E_NOW, E_BEFORE = "errors / CAST(greatest(total,1) AS DOUBLE)", "b_errors / CAST(greatest(b_total,1) AS DOUBLE)"
RULES = {
    "latency_regression": _ratio("p95", "b_p95", 1.5, 5.0),
    "error_rate_regression": (
        f"CASE WHEN ({E_BEFORE}) <= 0 THEN CASE WHEN {E_NOW} > 0.05 THEN 'fail' ELSE 'pass' END WHEN ({E_NOW}) / ({E_BEFORE}) > 1.5 THEN 'fail' ELSE 'pass' END",
        fx(f"CASE WHEN ({E_BEFORE}) <= 0 AND {E_NOW} <= 0.05 THEN 1.0 ELSE greatest(0.0, 1 - ({E_NOW})) END", 2),
        f"CASE WHEN ({E_BEFORE}) > 0 THEN {fx(f'({E_NOW}) / ({E_BEFORE})', 6)} END",
    ),
    "token_efficiency": _ratio("tokens / CAST(greatest(sessions,1) AS DOUBLE)", "b_tokens / CAST(greatest(b_sessions,1) AS DOUBLE)", 2.0, 10.0),
    "cost_regression": _ratio("cost / CAST(greatest(sessions,1) AS DOUBLE)", "b_cost / CAST(greatest(b_sessions,1) AS DOUBLE)", 2.0, 10.0),
    "tool_coverage": (
        "CASE WHEN known = 0 THEN 'pass' WHEN tools / CAST(known AS DOUBLE) < 0.5 THEN 'fail' WHEN tools / CAST(known AS DOUBLE) < 0.8 THEN 'degraded' ELSE 'pass' END",
        fx("CASE WHEN known = 0 THEN 1.0 ELSE tools / CAST(known AS DOUBLE) END", 2),
        f"CASE WHEN known > 0 THEN {fx('tools / CAST(known AS DOUBLE)', 6)} END",
    ),
    "guardrail_block_rate": (
        "CASE WHEN guarded = 0 THEN 'pass' WHEN blocked / CAST(guarded AS DOUBLE) > 0.3 THEN 'fail' WHEN blocked / CAST(guarded AS DOUBLE) >= 0.1 THEN 'degraded' ELSE 'pass' END",
        fx("CASE WHEN guarded = 0 THEN 1.0 ELSE 1 - blocked / CAST(guarded AS DOUBLE) END", 2),
        f"CASE WHEN guarded > 0 THEN {fx('blocked / CAST(guarded AS DOUBLE)', 6)} END",
    ),
}


def _select(name):
    outcome, score, ratio = RULES[name]
    return f"SELECT scope, '{name}' AS evaluator, '{evaluate.DIMENSIONS[name]}' AS dimension, {outcome} AS outcome, {score} AS score, {ratio} AS ratio FROM mt"


def _run(spark, sf, names):
    out = evaluate.run(events(spark, sf), names, TIME, BEFORE, AS_OF, BY)
    return out.select("scope", "evaluator", "dimension", "outcome", "score", fixed(F.col("ratio"), 6).alias("ratio"))


def _evaluator(name):
    register(f"eval_{name}", f"{BASE} {_select(name)}")(lambda spark, sf: _run(spark, sf, [name]))


for _name in RULES:
    _evaluator(_name)

JUDGE = "SELECT scope, 'llm_judge' AS evaluator, 'quality' AS dimension, 'pass' AS outcome, CAST(1.0 AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS ratio FROM mt"
ALL = " UNION ALL ".join([*(_select(n) for n in RULES), JUDGE])

register(
    "eval_summary",
    f"""{BASE}, r AS ({ALL}) SELECT scope, CASE max(CASE outcome WHEN 'fail' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'degraded' ELSE 'pass' END AS overall_outcome,
    {fx("CAST(sum(CAST(score AS DECIMAL(20,6))) AS DOUBLE) / count(*)", 2)} AS average_score, count(*) AS evaluator_count FROM r GROUP BY scope""",
)(lambda spark, sf: evaluate.summary(evaluate.run(events(spark, sf), None, TIME, BEFORE, AS_OF, BY)))


@register(
    "eval_result_rows",
    f"""{BASE}, r AS ({ALL}) SELECT CASE outcome WHEN 'pass' THEN 'success' ELSE 'failure' END AS event_outcome, evaluator AS evaluation_evaluator,
    score AS evaluation_score, outcome AS evaluation_outcome, dimension AS evaluation_dimension, 'internal.evaluation' AS event_dataset FROM r""",
)
def eval_result_rows(spark, sf):
    results = evaluate.run(events(spark, sf), None, TIME, BEFORE, AS_OF, BY)
    return evaluate.result_events(results, "run").select(
        "event_outcome", "evaluation_evaluator", "evaluation_score", "evaluation_outcome", "evaluation_dimension", "event_dataset"
    )


@register(
    "eval_per_tool",
    f"""{EV} SELECT tool_name, count(*) AS total, count(*) FILTER ({FAIL}) AS failures, {fx('quantile_cont(event_duration, 0.95) / 1e6', 4)} AS p95_ms
    FROM ev WHERE {NOT_INTERNAL} AND ts >= {NOW} - INTERVAL 31 DAY AND ts <= {NOW} AND tool_name IS NOT NULL GROUP BY 1 ORDER BY total DESC, 1 LIMIT 20""",
)
def eval_per_tool(spark, sf):
    out = evaluate.per_tool(events(spark, sf), "now-31d", AS_OF)
    return out.select("tool_name", "total", "failures", fixed(F.col("p95_ms"), 4).alias("p95_ms"))


@register(
    "judge_sample",
    """WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, '- [] tool= model=: ' || text AS line
    FROM conversations WHERE text IS NOT NULL) SELECT conv_id, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS sample FROM r WHERE rank <= 5 GROUP BY conv_id""",
)
def judge_sample(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("message"))
    return evaluate.judge_samples(rows, "conv_id", [F.col("turn").desc()])


REPLY_SHAPES = """CASE event_id % 5 WHEN 0 THEN '{"score": ' || CAST(user_id % 11 AS VARCHAR(9)) || ', "rationale": "x"}' WHEN 1 THEN 'I would say ' || CAST(user_id % 10 AS VARCHAR(9)) || ' of 10'
 WHEN 2 THEN '{"rationale": "9"}' WHEN 3 THEN event_type || ' without a number' ELSE '{"score": "7.5"}' END"""


@register(
    "judge_parse",
    f"""WITH r AS (SELECT event_id, user_id, event_type, {REPLY_SHAPES} AS reply FROM events),
    s AS (SELECT event_id, reply, CASE event_id % 5 WHEN 0 THEN CAST(user_id % 11 AS DOUBLE) WHEN 1 THEN CAST(user_id % 10 AS DOUBLE) WHEN 2 THEN 5.0 WHEN 3 THEN 5.0 ELSE 7.5 END / 10 AS raw FROM r)
    SELECT event_id, reply, {fx('raw', 2)} AS score, CASE WHEN {fx('raw', 2)} < 0.4 THEN 'fail' WHEN {fx('raw', 2)} < 0.7 THEN 'degraded' ELSE 'pass' END AS outcome FROM s""",
)
def judge_parse(spark, sf):
    shape = REPLY_SHAPES.replace("VARCHAR(9)", "STRING")
    replies = table(spark, sf, "events").selectExpr("event_id", f"{shape} AS reply")
    return evaluate.judge_scores(replies)


METRICS = ("total", "errors", "tokens", "sessions", "guarded", "blocked")
register(
    "eval_window_metrics",
    f"{BASE} SELECT scope, "
    + ", ".join(f"CAST({p}{m} AS BIGINT) AS {p}{m}" for p in ("", "b_") for m in METRICS)
    + f", cost, b_cost, {fx('p95', 4)} AS p95_ms, {fx('b_p95', 4)} AS b_p95_ms, tools, known AS known_tools FROM mt",
)(
    lambda spark, sf: evaluate.window_metrics(events(spark, sf), TIME, BEFORE, AS_OF, BY).select(
        "scope",
        *[f"{p}{m}" for p in ("", "b_") for m in METRICS],
        "cost",
        "b_cost",
        fixed(F.col("p95_ms"), 4).alias("p95_ms"),
        fixed(F.col("b_p95_ms"), 4).alias("b_p95_ms"),
        "tools",
        "known_tools",
    )
)

INSTRUCTIONS = "Rate the quality of these messages from 0 to 10."
register(
    "judge_prompt",
    f"""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, '- [] tool= model=: ' || text AS line
    FROM conversations WHERE text IS NOT NULL) SELECT conv_id, md5('{INSTRUCTIONS}' || chr(10) || string_agg(line, chr(10) ORDER BY rank)) AS digest FROM r WHERE rank <= 5 GROUP BY conv_id""",
)(lambda spark, sf: evaluate.judge_prompt(judge_sample(spark, sf), INSTRUCTIONS).select("conv_id", F.md5("prompt").alias("digest")))


# One reply per service, scored, in place of the skipped judge rows.
REPLY = "'Overall ' || CAST(count(*) % 11 AS VARCHAR(9)) || ' of 10'"
register(
    "eval_with_judge",
    f"""{BASE}, a AS ({ALL}), j AS (SELECT 'service_name=svc-' || (user_id % 4) AS scope, CAST(count(*) % 11 AS DOUBLE) / 10 AS s FROM events GROUP BY 1)
    SELECT a.scope, evaluator, CASE WHEN evaluator = 'llm_judge' AND s IS NOT NULL THEN CASE WHEN s < 0.4 THEN 'fail' WHEN s < 0.7 THEN 'degraded' ELSE 'pass' END ELSE outcome END AS outcome,
    CASE WHEN evaluator = 'llm_judge' AND s IS NOT NULL THEN s ELSE score END AS score FROM a LEFT JOIN j ON j.scope = a.scope""",
)(lambda spark, sf: _with_judge(spark, sf))


def _with_judge(spark, sf):
    reply = REPLY.replace("VARCHAR(9)", "STRING")
    replies = spark.sql(
        f"SELECT 'service_name=svc-' || (user_id % 4) AS scope, {reply} AS reply FROM {{events}} GROUP BY 1", events=table(spark, sf, "events")
    )
    results = evaluate.run(events(spark, sf), None, TIME, BEFORE, AS_OF, BY)
    return evaluate.with_judge(results, evaluate.judge_scores(replies)).select("scope", "evaluator", "outcome", "score")
