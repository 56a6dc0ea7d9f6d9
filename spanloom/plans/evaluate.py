"""Regression evaluators: a current window against a baseline, for every scope in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import count_if, failed, fixed, internal, keep_external, money, total
from ..functions.timeframe import at_least, at_most, split_range, within
from ..operators.facets import best
from ..operators.quantiles import merge_groups, quantiles
from .alerts import two_windows

TIME_RANGE = "now-1h"
BASELINE_RANGE = "now-7d/now-1h"

# What each evaluator measures.
DIMENSIONS = {
    "latency_regression": "latency",
    "error_rate_regression": "quality",
    "token_efficiency": "cost",
    "cost_regression": "cost",
    "tool_coverage": "quality",
    "guardrail_block_rate": "safety",
    "llm_judge": "quality",
}
BLOCKED = ("block", "redact")


def _rows(events: DataFrame, time_range: str, baseline_range: str, as_of, by: Sequence[str]) -> DataFrame:
    low, high = split_range(baseline_range, "now-7d", "now-1h")
    current = at_least(events, time_range, as_of) & at_most(events, "now", as_of)
    return two_windows(keep_external(events, "all"), current, within(events, f"{low}/{high}", as_of), by)


def _additive(side: Column | None = None) -> dict[str, Column]:
    """Counts and sums of one side's rows."""
    mine = F.lit(True) if side is None else side
    tokens = F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
    return {
        "total": count_if(mine),
        "errors": count_if(mine & failed()),
        "tokens": total(F.when(mine, tokens)),
        "cost": total(F.when(mine, money("cost"))),
        "guarded": count_if(mine & F.col("guardrail_action").isNotNull()),
        "blocked": count_if(mine & F.col("guardrail_action").isin(*BLOCKED)),
    }


SIDES = (("", "current"), ("b_", "baseline"))
_EMPTY = {
    "sessions": "bigint", "b_sessions": "bigint", "tools": "bigint", "known_tools": "bigint", "missing_tools": "array<string>",
    "p95_ms": "double", "b_p95_ms": "double",
}


def window_metrics(
    events: DataFrame, time_range=TIME_RANGE, baseline_range=BASELINE_RANGE, as_of=None, by: Sequence[str] = (), approx=False, p95=True, sets=True
) -> DataFrame:
    """One row per scope; columns of the baseline start with ``b_``.

    The additive measures ride along with the percentile passes; sessions and tools are
    counted from one pass over their distinct keys.
    """
    rows = _rows(events, time_range, baseline_range, as_of, by)
    if p95:
        present = F.array_compact(F.array(*[F.when(F.col(f"in_{side}"), side) for _, side in SIDES]))
        spread = rows.withColumn("side", F.explode(present))
        per = quantiles(spread, ["scope", "side"], "event_duration", {"p95": 0.95}, approx, measures=_additive())
        named = per.withColumn("p95_ms", F.col("p95") / F.lit(1e6))
        base = named.groupBy("scope").agg(
            *[F.max(F.when(F.col("side") == side, F.col(n))).alias(f"{prefix}{n}") for prefix, side in SIDES for n in (*_additive(), "p95_ms")]
        )
    else:
        measures = [c.alias(f"{prefix}{n}") for prefix, side in SIDES for n, c in _additive(F.col(f"in_{side}")).items()]
        base = rows.groupBy("scope").agg(*measures)
    merged = merge_groups(["scope"], base, *(key_sets(rows) if sets else []))
    out = []
    for name in ["scope", *[f"{prefix}{n}" for prefix, _ in SIDES for n in _additive()], *_EMPTY]:
        kind = "double" if name in ("cost", "b_cost") else _EMPTY.get(name, "bigint")
        empty = (F.array() if kind.startswith("array") else F.lit(0)).cast(kind)
        if name == "scope":
            out.append(F.col(name))
        else:
            out.append((F.coalesce(F.col(name).cast(kind), empty) if name in merged.columns else empty).alias(name))
    return merged.select(*out)


def key_sets(rows: DataFrame) -> list[DataFrame]:
    """Distinct sessions and tools per window, tools known from either, and the first missing ones."""
    keys = F.array(
        F.struct(F.lit("session").alias("kind"), F.col("conversation_id").alias("key")),
        F.struct(F.lit("tool").alias("kind"), F.col("tool_name").alias("key")),
    )
    seen = (
        rows.select("scope", "in_current", "in_baseline", F.explode(keys).alias("k"))
        .where(F.col("k.key").isNotNull())
        .groupBy("scope", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
        .agg(F.max("in_current").alias("now"), F.max("in_baseline").alias("before"))
    )
    session, tool = F.col("kind") == "session", F.col("kind") == "tool"
    counts = seen.groupBy("scope").agg(
        count_if(session & F.col("now")).alias("sessions"),
        count_if(session & F.col("before")).alias("b_sessions"),
        count_if(tool & F.col("now")).alias("tools"),
        count_if(tool).alias("known_tools"),
    )
    missing = (
        seen.where(tool & ~F.col("now"))
        .groupBy("scope")
        .agg(F.array_sort(F.collect_list("key")).alias("missing_tools"))
    )
    return [counts, missing]


def per_tool(events: DataFrame, time_range=TIME_RANGE, as_of=None, size: int | None = 20, approx=False) -> DataFrame:
    """Calls, failures and P95 per tool in the current window."""
    rows = keep_external(events, "all").where(
        at_least(events, time_range, as_of) & at_most(events, "now", as_of) & F.col("tool_name").isNotNull()
    )
    measures = {"total": F.count(F.lit(1)), "failures": count_if(failed())}
    found = quantiles(rows, ["tool_name"], "event_duration", {"p95": 0.95}, approx, measures=measures)
    named = found.select("tool_name", "total", "failures", (F.col("p95") / F.lit(1e6)).alias("p95_ms"))
    return best(named, "tool_name", "total", size)


def _verdict(outcome: Column, score: Column, ratio: Column, detail: Column) -> dict:
    return {"outcome": outcome, "score": score, "ratio": ratio, "detail": detail}


def _ratio_rule(now: Column, before: Column, threshold: float, fall: float, what: str) -> dict:
    """Shared shape of the latency, token and cost rules."""
    ratio = F.when(before > 0, now / before)
    regressed = ratio > threshold
    score = (
        F.when(ratio.isNull(), 1.0)
        .when(regressed, F.greatest(F.lit(0.0), 1 - (ratio - 1) / F.lit(fall)))
        .otherwise(F.least(F.lit(1.0), 1 / F.greatest(F.lit(0.1), ratio)))
    )
    numbers = F.concat(F.format_number(now, 4), F.lit(" now, "), F.format_number(before, 4), F.lit(" before"))
    detail = (
        F.when(ratio.isNull(), F.concat(F.lit(what), F.lit(": no baseline")))
        .when(regressed, F.concat(F.lit(what), F.lit(" grew: "), numbers))
        .otherwise(F.concat(F.lit(what), F.lit(" steady: "), numbers))
    )
    return _verdict(F.when(F.coalesce(regressed, F.lit(False)), "fail").otherwise("pass"), fixed(score, 2), ratio, detail)


def _per_session(value: str, prefix: str = "") -> Column:
    return F.col(f"{prefix}{value}") / F.greatest(F.col(f"{prefix}sessions"), F.lit(1)).cast("double")


def latency_regression(threshold: float = 1.5) -> dict:
    return _ratio_rule(F.col("p95_ms"), F.col("b_p95_ms"), threshold, 5.0, "P95 latency")


def error_rate_regression(threshold: float = 1.5) -> dict:
    now = F.col("errors") / F.greatest(F.col("total"), F.lit(1)).cast("double")
    before = F.col("b_errors") / F.greatest(F.col("b_total"), F.lit(1)).cast("double")
    ratio = F.when(before > 0, now / before)
    fails = F.when(ratio.isNull(), now > 0.05).otherwise(ratio > threshold)
    score = F.when(ratio.isNull() & ~fails, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - now))
    detail = F.concat(
        F.lit("error rate "), F.format_number(now * 100, 1), F.lit("%, baseline "), F.format_number(before * 100, 1), F.lit("%")
    )
    return _verdict(F.when(fails, "fail").otherwise("pass"), fixed(score, 2), ratio, detail)


def token_efficiency(threshold: float = 2.0) -> dict:
    return _ratio_rule(_per_session("tokens"), _per_session("tokens", "b_"), threshold, 10.0, "Tokens per session")


def cost_regression(threshold: float = 2.0) -> dict:
    return _ratio_rule(_per_session("cost"), _per_session("cost", "b_"), threshold, 10.0, "Cost per session")


def tool_coverage() -> dict:
    share = F.when(F.col("known_tools") > 0, F.col("tools") / F.col("known_tools").cast("double"))
    outcome = F.when(share < 0.5, "fail").when(share < 0.8, "degraded").otherwise("pass")
    detail = F.concat(
        F.col("tools").cast("string"), F.lit(" of "), F.col("known_tools").cast("string"), F.lit(" tools called"),
        F.when(F.size("missing_tools") > 0, F.concat(F.lit("; not called: "), F.array_join("missing_tools", ", "))).otherwise(""),
    )
    return _verdict(outcome, fixed(F.coalesce(share, F.lit(1.0)), 2), share, detail)


def guardrail_block_rate() -> dict:
    share = F.when(F.col("guarded") > 0, F.col("blocked") / F.col("guarded").cast("double"))
    outcome = F.when(share > 0.3, "fail").when(share >= 0.1, "degraded").otherwise("pass")
    detail = F.concat(F.col("blocked").cast("string"), F.lit(" of "), F.col("guarded").cast("string"), F.lit(" guardrail checks blocked or redacted"))
    return _verdict(outcome, fixed(1 - F.coalesce(share, F.lit(0.0)), 2), share, detail)


def judge_not_asked() -> dict:
    """Stands in until replies are given to ``with_judge``: a pass, as for any check without data."""
    return _verdict(F.lit("pass"), F.lit(1.0), F.lit(None), F.lit("skipped: no replies"))


EVALUATORS: dict[str, Callable[[], dict]] = {
    "latency_regression": latency_regression,
    "error_rate_regression": error_rate_regression,
    "token_efficiency": token_efficiency,
    "cost_regression": cost_regression,
    "tool_coverage": tool_coverage,
    "guardrail_block_rate": guardrail_block_rate,
    "llm_judge": judge_not_asked,
}


def register_evaluator(name: str, rule: Callable[[], dict], dimension: str = "quality") -> None:
    """Add a rule over the window metrics; it returns outcome, score, ratio and detail columns."""
    EVALUATORS[name] = rule
    DIMENSIONS[name] = dimension


def _checked(name: str, wide: DataFrame) -> dict:
    try:
        found = EVALUATORS[name]()
        wide.select(_result(name, found).alias("e"))  # resolves the rule against the metrics
        return found
    except Exception as problem:  # a broken rule is a failed evaluation, not a failed run
        reason = str(problem).splitlines()[0] if str(problem) else type(problem).__name__
        return _verdict(F.lit("fail"), F.lit(0.0), F.lit(None), F.lit(f"evaluator failed: {reason}"))


def run(
    events: DataFrame,
    evaluators: Sequence[str] | None = None,
    time_range: str = TIME_RANGE,
    baseline_range: str = BASELINE_RANGE,
    as_of=None,
    by: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """One row per scope and evaluator. Unknown names are left out."""
    names = [n for n in (evaluators or EVALUATORS) if n in EVALUATORS]
    wide = window_metrics(
        events, time_range, baseline_range, as_of, by, approx,
        p95=any(n == "latency_regression" or n not in _BUILT_IN for n in names),
        sets=any(n in _NEED_SETS or n not in _BUILT_IN for n in names),
    )
    rows = F.array(*[_result(name, _checked(name, wide)) for name in names])
    return wide.select("scope", F.explode(rows).alias("e")).select("scope", "e.*")


_BUILT_IN = frozenset(EVALUATORS)
_NEED_SETS = ("token_efficiency", "cost_regression", "tool_coverage")


def _result(name: str, found: dict) -> Column:
    return F.struct(
        F.lit(name).alias("evaluator"),
        F.lit(DIMENSIONS.get(name, "quality")).alias("dimension"),
        found["outcome"].alias("outcome"),
        found["score"].cast("double").alias("score"),
        found["ratio"].cast("double").alias("ratio"),
        found["detail"].alias("detail"),
    )


def summary(results: DataFrame) -> DataFrame:
    """Worst outcome and mean score per scope."""
    rank = F.when(F.col("outcome") == "fail", 2).when(F.col("outcome") == "degraded", 1).otherwise(0)
    worst = F.max(rank)
    return results.groupBy("scope").agg(
        F.when(worst == 2, "fail").when(worst == 1, "degraded").otherwise("pass").alias("overall_outcome"),
        fixed(F.sum(F.col("score").cast("decimal(20,6)")).cast("double") / F.count(F.lit(1)), 2).alias("average_score"),
        F.count(F.lit(1)).alias("evaluator_count"),
    )


def result_events(results: DataFrame, run_id: str, evaluated_at: Column | None = None) -> DataFrame:
    """Results as event rows to append; only a pass counts as success."""
    return results.select(
        (evaluated_at if evaluated_at is not None else F.current_timestamp()).alias("ts"),
        F.lit("event").alias("event_kind"),
        F.lit("process").alias("event_category"),
        F.lit("evaluation").alias("event_action"),
        F.when(F.col("outcome") == "pass", "success").otherwise("failure").alias("event_outcome"),
        F.lit("internal.evaluation").alias("event_dataset"),
        F.lit("evaluate").alias("service_name"),
        F.lit("evaluation").alias("operation_name"),
        F.lit(run_id).alias("evaluation_run_id"),
        F.col("evaluator").alias("evaluation_evaluator"),
        F.col("score").alias("evaluation_score"),
        F.col("outcome").alias("evaluation_outcome"),
        F.col("dimension").alias("evaluation_dimension"),
        F.concat(F.lit("["), F.upper("outcome"), F.lit("] "), F.col("evaluator"), F.lit(": "), F.col("detail")).alias("message"),
    )


# ---------------------------------------------------------------- judge
SAMPLES = 5


def judge_samples(messages: DataFrame, group: str, newest_first: Sequence[Column], size: int = SAMPLES) -> DataFrame:
    """The newest messages per group as sample lines: ``group, n, sample``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*newest_first))
    have = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in messages.columns else F.lit("") for c in ("event_outcome", "tool_name", "request_model")}
    line = F.concat(
        F.lit("- ["), have["event_outcome"], F.lit("] tool="), have["tool_name"], F.lit(" model="), have["request_model"], F.lit(": "),
        F.col("message"),
    )
    top = messages.where(F.col("message").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= size)
    return (
        top.select(group, "rank", line.alias("line"))
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda e: e["line"]), "\n").alias("sample"),
        )
    )


def judge_samples_from_events(events: DataFrame, time_range: str = TIME_RANGE, as_of=None, group: str = "service_name") -> DataFrame:
    rows = events.where(~internal("all") & at_least(events, time_range, as_of))
    return judge_samples(rows, group, [F.col("ts").desc(), F.col("span_id").asc_nulls_last()])


def judge_prompt(samples: DataFrame, instructions: str) -> DataFrame:
    """Instructions followed by the samples; sending it to a model is left to the caller."""
    return samples.withColumn("prompt", F.concat(F.lit(instructions.rstrip() + "\n"), F.col("sample")))


# Fixed value: what counts as a number in a reply.
NUMBER = r"\b(\d+(?:\.\d+)?)\b"


def judge_scores(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Score replies: a JSON ``score``, else the first number in the text, else 5; out of ten."""
    parsed = F.try_parse_json(F.col(reply))
    as_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    given = F.try_variant_get(parsed, "$.score", "double")
    number = F.regexp_extract(F.col(reply), NUMBER, 1).try_cast("double")
    # an object without a score counts as 5, one with an unreadable score as plain text
    absent = F.try_variant_get(parsed, "$.score", "string").isNull()
    raw = F.when(as_object & absent, F.lit(5.0)).when(as_object & given.isNotNull(), given).otherwise(F.coalesce(number, F.lit(5.0)))
    score = fixed(raw / 10, 2)
    return replies.withColumn("score", score).withColumn(
        "outcome", F.when(score < 0.4, "fail").when(score < 0.7, "degraded").otherwise("pass")
    )


def with_judge(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Evaluation results with the judge's rows replaced by scored replies (``scope, score, outcome``)."""
    judged = scores.select(
        "scope",
        F.lit("llm_judge").alias("evaluator"),
        F.lit(DIMENSIONS["llm_judge"]).alias("dimension"),
        "outcome",
        F.col("score").cast("double").alias("score"),
        F.lit(None).cast("double").alias("ratio"),
        F.concat(F.lit("judged "), F.format_number(F.col("score") * 10, 1), F.lit(" of 10")).alias("detail"),
    )
    asked = F.col("_asked").isNotNull() & (F.col("evaluator") == "llm_judge")
    marked = results.join(scores.select("scope").distinct().withColumn("_asked", F.lit(True)), "scope", "left")
    return marked.where(~asked).drop("_asked").unionByName(judged)
