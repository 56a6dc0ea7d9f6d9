"""Six alert analyzers over a current and a baseline window, for every scope in one job.

A scope is the whole table (``all``) or one value of a column (``service_name=x``).
One row per scope carries the window metrics and the ranked evidence lists; the
analyzers are expressions over that row.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import count_if, exact, failed, fixed, keep_external, top_key, total
from ..functions.timeframe import at_least, within
from ..operators.facets import best, facet_counts, ranked_lists
from ..operators.quantiles import counted_quantiles, merge_groups, quantiles, sliding_counted, value_bucket
from ..session import cut, written
from .report import turns_by_latency, turns_from_counts


@dataclass(frozen=True)
class Rules:
    # Default thresholds and windows.
    error_threshold: int = 10
    p95_latency_threshold_ms: float = 5000.0
    token_threshold_multiplier: float = 3.0
    time_range: str = "now-15m"
    baseline_range: str = "now-24h/now-15m"


def load_rules(source: str | Mapping | None, base: Rules = Rules()) -> Rules:
    """Rules from JSON text or a mapping; keys left out keep their default."""
    given = json.loads(source) if isinstance(source, str) else dict(source or {})
    known = {f.name: f.type for f in fields(Rules)}
    return replace(base, **{k: v for k, v in given.items() if k in known})


LIST_SIZE = 5
FACETS = {
    "session": "conversation_id",
    "tool": "tool_name",
    "model": "request_model",
    "component": "component_type",
    "error": "error_type",
}
# list -> (facet, measure)
LISTS = {
    "top_error_types": ("error", "count"),
    "top_error_tools": ("tool", "failures"),
    "top_error_models": ("model", "failures"),
    "top_failure_sessions": ("session", "failures"),
    "top_failure_components": ("component", "failures"),
    "top_tools": ("tool", "tokens"),
    "top_models": ("model", "tokens"),
    "top_token_sessions": ("session", "tokens"),
    "top_retry_sessions": ("session", "retries"),
    "top_retry_tools": ("tool", "retries"),
}
FAILURE_LISTS = ("top_error_tools", "top_error_models", "top_failure_sessions", "top_failure_components")
ENTRY = "array<struct<rank:int,key:string,count:bigint,value:double>>"
TURN = (
    "array<struct<rank:int,key:string,count:bigint,value:double,failure_count:bigint,"
    "session_id:string,component_type:string>>"
)
EVIDENCE_LISTS = {**{name: ENTRY for name in LISTS}, "top_latency_tools": ENTRY, "top_turns": TURN}
NUMBERS = {
    "error_count": "bigint", "error_rate": "double", "baseline_rate": "double",
    "current_tokens": "bigint", "baseline_tokens": "bigint", "ratio": "double",
    "p95_ms": "double", "baseline_p95_ms": "double", "threshold_ms": "double",
    "total_failures": "bigint", "session_failures": "bigint", "concentration": "double",
    "total_retries": "bigint", "baseline_retries": "bigint", "baseline_multiplier": "double",
    "turn_latency_ms": "double",
}
NAMES = ("primary_type", "primary_tool", "primary_model", "primary_session", "primary_component", "primary_turn", "primary_session_source")
TEXTS = ("phenomenon", "root_cause", "recommendation")

# alert type -> evidence lists it shows
EVIDENCE_OF = {
    "error_rate_spike": ("top_error_types", "top_error_tools", "top_error_models", "top_failure_sessions"),
    "token_consumption_anomaly": ("top_tools", "top_models", "top_token_sessions", "top_retry_sessions"),
    "latency_degradation": ("top_latency_tools", "top_turns"),
    "session_failure_hotspot": ("top_failure_sessions", "top_failure_components"),
    "retry_storm": ("top_retry_sessions", "top_retry_tools"),
    "long_turn_hotspot": ("top_turns",),
}

# Lists that count as independent signals for the confidence.
SIGNALS = (
    "top_error_tools", "top_error_models", "top_latency_tools", "top_tools", "top_models",
    "top_failure_sessions", "top_retry_sessions", "top_turns", "top_failure_components",
)


def scoped(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Repeat each row for ``all`` and for its value of every ``by`` column."""
    scopes = [F.lit("all")] + [F.concat(F.lit(f"{c}="), F.col(c)) for c in by]
    if not by:
        return rows.withColumn("scope", F.lit("all"))
    return rows.withColumn("scope", F.explode(F.array_compact(F.array(*scopes))))


def two_windows(events: DataFrame, current: Column, baseline: Column, by: Sequence[str]) -> DataFrame:
    """External rows of either window, flagged; a boundary row belongs to both."""
    flagged = events.withColumn("in_current", current).withColumn("in_baseline", baseline)
    return scoped(flagged.where(F.col("in_current") | F.col("in_baseline")), by)


def _additive(side: Column | None = None) -> dict[str, Column]:
    """Counts and sums of one side's rows."""
    mine = F.lit(True) if side is None else side
    tokens = F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
    return {
        "events": count_if(mine),
        "errors": count_if(mine & failed()),
        "tokens": total(F.when(mine, tokens)),
        "retries": total(F.when(mine, F.col("retry_count"))).cast("bigint"),
    }


def windowed_p95(rows: DataFrame, approx: bool = False) -> DataFrame:
    """P95 of the duration in milliseconds and the additive measures: both windows as a
    whole (tool null), and the current window per tool, from one pair of passes."""
    side = [
        F.when(F.col("in_current"), F.struct(F.lit("current").alias("side"), F.lit(None).cast("string").alias("tool"))),
        F.when(F.col("in_baseline"), F.struct(F.lit("baseline").alias("side"), F.lit(None).cast("string").alias("tool"))),
        F.when(
            F.col("in_current") & F.col("tool_name").isNotNull(),
            F.struct(F.lit("current").alias("side"), F.col("tool_name").alias("tool")),
        ),
    ]
    inputs = ["scope", "event_duration", "event_outcome", "input_tokens", "output_tokens", "retry_count"]
    spread = rows.select(*inputs, F.explode(F.array_compact(F.array(*side))).alias("w")).select(*inputs, "w.side", "w.tool")
    p95 = quantiles(
        spread, ["scope", "side", "tool"], "event_duration", {"p95": 0.95}, approx, measures=_additive()
    )
    return p95.withColumn("p95", F.col("p95") / F.lit(1e6))


def snapshot(
    events: DataFrame, rules: Rules = Rules(), as_of=None, by: Sequence[str] = (), approx: bool = False, only: Sequence[str] = ()
) -> DataFrame:
    """One row per scope: window metrics and the evidence lists.

    ``only`` names the alert types wanted; what no one of them reads is not computed.
    """
    external = keep_external(events, "all")
    rows = two_windows(
        external, at_least(events, rules.time_range, as_of), within(events, rules.baseline_range, as_of), by
    )
    parts = _evidence(rows, only, approx)
    if not any("errors" in part.columns for part in parts):  # else they came along with the percentiles
        sides = (("", F.col("in_current")), ("b_", F.col("in_baseline")))
        measures = [c.alias(f"{prefix}{n}") for prefix, side in sides for n, c in _additive(side).items()]
        parts = [rows.groupBy("scope").agg(*measures), *parts]
    return _assemble(parts, rules)


def _evidence(rows: DataFrame, only: Sequence[str], approx: bool) -> list[DataFrame]:
    """Per-scope evidence lists and P95 of the wanted alert types, from flagged rows."""
    wanted = {name for kind, lists in EVIDENCE_OF.items() if not only or kind in only for name in lists}
    needs_p95 = "top_latency_tools" in wanted
    current = rows.where(F.col("in_current"))
    parts = []
    facet_lists = {name: source for name, source in LISTS.items() if name in wanted}
    if facet_lists:
        used = {facet for facet, _ in facet_lists.values()}
        facets = {name: column for name, column in FACETS.items() if name in used}
        counts = facet_counts(
            current.select("scope", "event_outcome", "input_tokens", "retry_count", *facets.values()),
            facets,
            ["scope"],
            failures=count_if(failed()),
            tokens=total("input_tokens"),
            retries=total("retry_count"),
        )
        parts.append(_top_lists(counts, facet_lists))
    if needs_p95:
        p95 = cut(windowed_p95(rows, approx))  # one row per scope, side and tool, read twice
        sides = (("", "current"), ("b_", "baseline"))
        whole = p95.where(F.col("tool").isNull()).groupBy("scope").agg(
            *[F.max(F.when(F.col("side") == side, F.col("p95"))).alias(f"{prefix}p95_ms") for prefix, side in sides],
            *[
                F.coalesce(F.max(F.when(F.col("side") == side, F.col(n))), F.lit(0)).alias(f"{prefix}{n}")
                for prefix, side in sides
                for n in _additive()
            ],
        )
        parts += [whole, _latency_tools(p95.where(F.col("tool").isNotNull()))]
    if "top_turns" in wanted:
        parts.append(_slow_turns(current))
    return parts


def _top_lists(counts: DataFrame, lists: Mapping[str, tuple[str, str]]) -> DataFrame:
    ranked = ranked_lists(counts, lists, LIST_SIZE, ["scope"], FAILURE_LISTS)
    entry = F.struct("rank", "key", "count", "value")
    return ranked.groupBy("scope").agg(*[F.array_sort(F.collect_list(F.when(F.col("list") == n, entry))).cast(ENTRY).alias(n) for n in lists])


def window_facts(events: DataFrame, every: str = "15 minutes", by: Sequence[str] = (), ts: str = "ts", lists: Collection[str] | None = None) -> DataFrame:
    """All that an alert check asks of a window, counted: one row per window, scope and counted thing (``kind``, ``key``, ``other``, ``number``).

    Works on tables and, with a watermark on ``ts``, on streams. Kinds: ``all``; the facets; ``bucket`` (value bucket of the duration, on
    streams); ``duration`` (its value, per tool); ``turn_session`` and ``turn_component``. ``lists`` names the evidence lists wanted.
    """
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def thing(kind: str, key: Column = text, other: Column = text, number: Column = none, needs: Column | None = None) -> Column:
        one = F.struct(F.lit(kind).alias("kind"), key.alias("key"), other.alias("other"), number.alias("number"))
        return one if needs is None else F.when(needs.isNotNull(), one)

    duration = F.col("event_duration")
    wanted = EVIDENCE_LISTS if lists is None else lists
    facets = {LISTS[name][0] for name in wanted if name in LISTS} | ({"tool"} if "top_latency_tools" in wanted else set())
    things = [thing("all"), thing("duration", F.col("tool_name"), number=duration, needs=duration)]
    things += [thing("bucket", number=value_bucket(duration), needs=duration)] if events.isStreaming else []
    things += [thing(facet, F.col(column), needs=F.col(column)) for facet, column in FACETS.items() if facet in facets]
    if "top_turns" in wanted:
        things += [thing(f"turn_{side}", F.col("turn_id"), F.col(FACETS[side]), needs=F.col("turn_id")) for side in ("session", "component")]
    measures = ["event_outcome", "input_tokens", "output_tokens", "retry_count", "latency_ms"]
    rows = scoped(keep_external(events, "all"), by).select(ts, F.col("scope").alias("base"), *measures, F.explode(F.array_compact(F.array(*things))).alias("t"))
    grouped = rows.groupBy(F.window(ts, every).alias("w"), "base", "t.kind", "t.key", "t.other", "t.number").agg(
        F.count(F.lit(1)).alias("count"),
        count_if(failed()).alias("failures"),
        total(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).cast("bigint").alias("tokens"),
        total("input_tokens").cast("bigint").alias("tokens_in"),
        total("retry_count").cast("bigint").alias("retries"),
        F.sum(exact("latency_ms")).alias("latency"),
        F.count("latency_ms").alias("timed"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def window_scope() -> Column:
    return F.concat("base", F.lit("@"), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def from_facts(facts: DataFrame, baseline: DataFrame, rules: Rules = Rules(), lists: Collection[str] | None = None) -> DataFrame:
    """The wide rows of the windows in ``facts`` (as ``window_facts`` counts them), without reading an event.

    ``baseline`` has ``scope`` and ``b_events``, ``b_errors``, ``b_tokens``, ``b_retries``, perhaps ``b_p95_ms``.
    """
    wanted = EVIDENCE_LISTS if lists is None else lists
    rows = facts.withColumn("scope", window_scope())
    whole = rows.where(F.col("kind") == "all").select("scope", F.col("count").alias("events"), F.col("failures").alias("errors"), "tokens", "retries")
    counts = rows.where(F.col("kind").isin(*FACETS)).select("scope", F.col("kind").alias("facet"), "key", "count", "failures", F.col("tokens_in").alias("tokens"), "retries")
    values = rows.where(F.col("kind") == "duration").select("scope", F.col("key").alias("tool"), F.col("number").alias("_v"), F.col("count").alias("_c"))
    parts = [whole, baseline]
    named = {name: source for name, source in LISTS.items() if name in wanted}
    if named:
        parts.append(_top_lists(counts, named))
    if "top_latency_tools" in wanted:
        p95 = counted_quantiles(values.drop("tool"), ["scope"], {"p95": 0.95}).select("scope", (F.col("p95") / F.lit(1e6)).alias("p95_ms"))
        per_tool = counted_quantiles(values.where(F.col("tool").isNotNull()), ["scope", "tool"], {"p95": 0.95})
        calls = counts.where(F.col("facet") == "tool").select("scope", F.col("key").alias("tool"), F.col("count").alias("events"))
        tools = _latency_tools(merge_groups(["scope", "tool"], calls, per_tool).withColumn("p95", F.col("p95") / F.lit(1e6)))
        parts += [p95, tools]
    if "top_turns" in wanted:
        sides = F.regexp_extract("kind", "^turn_(.*)$", 1)
        split = rows.where(F.col("kind").startswith("turn_"))
        split = split.select("scope", F.col("key").alias("turn_id"), sides.alias("side"), F.col("other").alias("key"), F.col("count").alias("n"), "failures", "latency", "timed")
        parts.append(_turn_lists(turns_from_counts(split, LIST_SIZE, ["scope"])))
    return _assemble(parts, rules)


def _assemble(parts: Sequence[DataFrame], rules: Rules) -> DataFrame:
    merged = merge_groups(["scope"], *parts)
    return merged.select(
        *[c for c in merged.columns if c not in EVIDENCE_LISTS],
        *[F.lit(None).cast("double").alias(c) for c in ("p95_ms", "b_p95_ms") if c not in merged.columns],
        *[
            (F.coalesce(F.col(name), F.array().cast(kind)) if name in merged.columns else F.array().cast(kind)).alias(name)
            for name, kind in EVIDENCE_LISTS.items()
        ],
        F.lit(rules.error_threshold).alias("t_errors"),
        F.lit(float(rules.p95_latency_threshold_ms)).alias("t_ms"),
        F.lit(float(rules.token_threshold_multiplier)).alias("t_tokens"),
    )


def per_window(
    events: DataFrame,
    every: str = "15 minutes",
    baseline: str = "24 hours",
    rules: Rules = Rules(),
    by: Sequence[str] = (),
    only: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """The wide rows of every tumbling window: each is compared with the time before it.

    Events are counted once, as facts; all else is read off those. Baselines are sums over a range frame of one row per scope
    and window. The baseline P95 is exact: counts per value bucket slide along, and only the bucket that holds the rank
    is opened.
    ``scope`` reads ``<scope>@<window start>``.
    """
    spans = events.sparkSession.range(1).select(*[F.expr(f"CAST(INTERVAL {length} AS INTERVAL SECOND)").cast("decimal(20,6)").cast("bigint") for length in (every, baseline)]).first()
    wanted = {name for kind, lists in EVIDENCE_OF.items() if not only or kind in only for name in lists}
    facts = written(window_facts(events, every, by, ts, wanted), "facts", "kind")  # the only scan of the events
    seconds = F.unix_timestamp(F.col("window_start").cast("timestamp"))
    frame = Window.partitionBy("base").orderBy(seconds).rangeBetween(-spans[1], -spans[0])
    names = {"events": "count", "errors": "failures", "tokens": "tokens", "retries": "retries"}
    whole = facts.where(F.col("kind") == "all").withColumn("scope", window_scope()).withColumn("_start", seconds)
    before = whole.select("base", "_start", "scope", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(f"b_{n}") for n, c in names.items()])
    values = facts.where(F.col("kind") == "duration").groupBy("base", seconds.alias("_at"), F.col("number").alias("_v")).agg(F.sum("count").alias("_c"))
    slid = sliding_counted(values, whole.select("base", F.col("_start").alias("_at")), "base", "_start", spans[0], spans[1], {"b_p95_ms": 0.95})
    b_p95 = slid.join(before.select("scope", "base", "_start"), ["base", "_start"]).select("scope", (F.col("b_p95_ms") / F.lit(1e6)).alias("b_p95_ms"))
    return from_facts(facts, merge_groups(["scope"], before.drop("base", "_start"), b_p95), rules, wanted)


def _latency_tools(p95: DataFrame) -> DataFrame:
    named = p95.select("scope", F.col("events").alias("count"), F.col("tool").alias("key"), F.col("p95").alias("value"))
    top = best(named, "key", "value", LIST_SIZE, ["scope"])
    entry = F.struct("rank", "key", "count", "value")
    return top.groupBy("scope").agg(F.array_sort(F.collect_list(entry)).cast(ENTRY).alias("top_latency_tools"))


def _slow_turns(current: DataFrame) -> DataFrame:
    return _turn_lists(turns_by_latency(current, LIST_SIZE, ["scope"]))


def _turn_lists(top: DataFrame) -> DataFrame:
    order = Window.partitionBy("scope").orderBy(F.col("avg_latency_ms").desc(), F.col("turn_id"))
    entry = F.struct(
        "rank", F.col("turn_id").alias("key"), F.col("doc_count").alias("count"),
        F.col("avg_latency_ms").alias("value"), "failure_count", "session_id", "component_type",
    )
    return (
        top.withColumn("rank", F.row_number().over(order))
        .groupBy("scope")
        .agg(F.array_sort(F.collect_list(entry)).cast(TURN).alias("top_turns"))
    )


def evidence_rows(wide: DataFrame) -> DataFrame:
    """The evidence lists of a snapshot in long form: ``scope, list, rank, key, count, value``."""
    plain = {n: F.col(n) for n in EVIDENCE_LISTS if n != "top_turns"}
    turns = F.transform("top_turns", lambda e: F.struct(e["rank"], e["key"], e["count"], e["value"])).cast(ENTRY)
    named = F.create_map(*[part for n, c in {**plain, "top_turns": turns}.items() for part in (F.lit(n), c)])
    lists = wide.select("scope", F.explode(named).alias("list", "entries"))
    return lists.select("scope", "list", F.explode("entries").alias("e")).select("scope", "list", "e.*")


def override(wide: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per-scope thresholds (``scope, error_threshold, p95_latency_threshold_ms, token_threshold_multiplier``)."""
    joined = wide.join(overrides, "scope", "left")
    pairs = {"t_errors": "error_threshold", "t_ms": "p95_latency_threshold_ms", "t_tokens": "token_threshold_multiplier"}
    return joined.select(
        *[
            F.coalesce(F.col(pairs[c]), F.col(c)).cast(wide.schema[c].dataType).alias(c) if c in pairs else F.col(c)
            for c in wide.columns
        ]
    )


def _or_unknown(column: Column) -> Column:
    return F.coalesce(column, F.lit("unknown"))


def _at_least_one(column: str) -> Column:
    return F.greatest(F.col(column), F.lit(1)).cast("double")


def _whole(column: Column) -> Column:
    return F.format_number(column, 0)


def _percent(column: Column) -> Column:
    return F.concat(F.format_number(column * 100, 1), F.lit("%"))


def _error_spike() -> dict:
    rate = fixed(F.col("errors") / _at_least_one("events"), 4)
    base = fixed(F.col("b_errors") / _at_least_one("b_events"), 4)
    kind = _or_unknown(top_key("top_error_types"))
    tool, model = _or_unknown(top_key("top_error_tools")), _or_unknown(top_key("top_error_models"))
    session = _or_unknown(top_key("top_failure_sessions"))
    dependency = F.lower(kind).contains("timeout") | F.lower(kind).contains("connection")
    return {
        "alert_type": "error_rate_spike",
        "fired": F.col("errors") >= F.col("t_errors"),
        "severe": rate > 0.5,
        "error_count": F.col("errors"), "error_rate": rate, "baseline_rate": base,
        "primary_type": kind, "primary_tool": tool, "primary_model": model, "primary_session": session,
        "phenomenon": F.concat(
            _whole(F.col("errors")), F.lit(" failures, an error rate of "), _percent(rate), F.lit("; the baseline rate is "), _percent(base), F.lit(".")
        ),
        "root_cause": F.concat(
            F.lit("Most frequent error type "), kind, F.lit("; most failing tool "), tool, F.lit(", model "), model, F.lit(", session "), session,
            F.lit(". Points to "), F.when(dependency, "a dependency that does not answer").otherwise("a fault in the application or its integration"), F.lit("."),
        ),
        "recommendation": F.concat(
            F.lit("Look for recent changes of tool "), tool, F.lit(", check quota and availability of "), model, F.lit(", then read session "), session, F.lit(".")
        ),
    }


def _token_anomaly() -> dict:
    ratio = fixed(F.col("tokens") / _at_least_one("b_tokens"), 2)
    by_tokens, by_retries = top_key("top_token_sessions"), top_key("top_retry_sessions")
    source = (
        F.when(F.size("top_token_sessions") > 0, "token").when(F.size("top_retry_sessions") > 0, "retry_fallback").otherwise("none")
    )
    session = _or_unknown(F.coalesce(by_tokens, by_retries))
    tool, model = _or_unknown(top_key("top_tools")), _or_unknown(top_key("top_models"))
    return {
        "alert_type": "token_consumption_anomaly",
        "fired": (F.col("b_tokens") > 0) & (F.col("tokens") > F.col("b_tokens") * F.col("t_tokens")),
        "severe": ratio >= 5,
        "current_tokens": F.col("tokens"), "baseline_tokens": F.col("b_tokens"), "ratio": ratio,
        "primary_tool": tool, "primary_model": model, "primary_session": session, "primary_session_source": source,
        "phenomenon": F.concat(
            _whole(F.col("tokens")), F.lit(" tokens against "), _whole(F.col("b_tokens")), F.lit(" in the baseline, "), ratio.cast("string"), F.lit(" times as many.")
        ),
        "root_cause": F.concat(
            F.lit("Largest consumers: tool "), tool, F.lit(", model "), model, F.lit(", session "), session, F.lit(". Suggests "),
            F.when(ratio > 5, "a loop or repeated retries").otherwise("more work or longer prompts"), F.lit("."),
        ),
        "recommendation": F.concat(
            F.lit("Check if "), tool, F.lit(" repeats one turn, compare prompts for "), model, F.lit(", set a token budget for session "), session, F.lit(".")
        ),
    }


def _latency() -> dict:
    p95 = F.coalesce(F.col("p95_ms"), F.lit(0.0))
    base = F.coalesce(F.col("b_p95_ms"), F.lit(0.0))
    turn = F.try_element_at(F.col("top_turns"), F.lit(1))
    tool, slow, session = _or_unknown(top_key("top_latency_tools")), _or_unknown(turn["key"]), _or_unknown(turn["session_id"])
    return {
        "alert_type": "latency_degradation",
        "fired": p95 >= F.col("t_ms"),
        "severe": p95 >= F.col("t_ms") * 2,
        "p95_ms": fixed(p95, 1), "baseline_p95_ms": fixed(base, 1), "threshold_ms": F.col("t_ms"),
        "primary_tool": tool, "primary_turn": slow, "primary_session": session,
        "phenomenon": F.concat(
            F.lit("P95 duration "), _whole(p95), F.lit(" ms; threshold "), _whole(F.col("t_ms")), F.lit(" ms, baseline "), _whole(base), F.lit(" ms.")
        ),
        "root_cause": F.concat(
            F.lit("Slowest tool "), tool, F.lit("; slowest turn "), slow, F.lit(" of session "), session, F.lit(". Points to "),
            F.when(p95 > 10000, "a slow endpoint downstream").otherwise("contention or more concurrency"), F.lit("."),
        ),
        "recommendation": F.concat(
            F.lit("Profile "), tool, F.lit(", read turn "), slow, F.lit(" of session "), session, F.lit(", and set request time limits.")
        ),
    }


def _session_hotspot() -> dict:
    hot = F.try_element_at(F.col("top_failure_sessions"), F.lit(1))
    share = hot["count"] / _at_least_one("errors")
    component, session = _or_unknown(top_key("top_failure_components")), _or_unknown(hot["key"])
    enough = F.greatest(F.lit(3), F.floor(F.col("t_errors") / 2))
    return {
        "alert_type": "session_failure_hotspot",
        "fired": (hot["count"] >= enough) & (share >= 0.35),
        "severe": share >= 0.6,
        "total_failures": F.col("errors"), "session_failures": hot["count"], "concentration": fixed(share, 4),
        "primary_session": session, "primary_component": component,
        "phenomenon": F.concat(
            F.lit("Session "), session, F.lit(" holds "), _whole(hot["count"]), F.lit(" of "), _whole(F.col("errors")), F.lit(" failures ("), _percent(share), F.lit(").")
        ),
        "root_cause": F.concat(
            F.lit("One conversation path fails, mostly in component "), component, F.lit(": a bad branch, broken state or a repeated faulty hand-over.")
        ),
        "recommendation": F.concat(
            F.lit("Read session "), session, F.lit(", compare it with sessions that succeed, and see if "), component, F.lit(" is the origin.")
        ),
    }


def _retry_storm() -> dict:
    hot = F.try_element_at(F.col("top_retry_sessions"), F.lit(1))
    most = F.coalesce(hot["value"], F.lit(0.0))
    multiplier = F.when(F.col("b_retries") != 0, F.col("retries") / _at_least_one("b_retries")).otherwise(F.col("retries").cast("double"))
    quiet = (most < F.greatest(F.lit(4), F.floor(F.col("t_errors") / 2))) & (F.col("retries") < F.greatest(F.lit(6), F.col("t_errors")))
    tool, session = _or_unknown(top_key("top_retry_tools")), _or_unknown(hot["key"])
    return {
        "alert_type": "retry_storm",
        "fired": (F.size("top_retry_sessions") > 0) & ~quiet,
        "severe": most >= F.greatest(F.lit(10), F.col("t_errors")),
        "total_retries": F.col("retries"), "baseline_retries": F.col("b_retries"), "baseline_multiplier": fixed(multiplier, 2),
        "primary_session": session, "primary_tool": tool,
        "phenomenon": F.concat(
            F.lit("Session "), session, F.lit(" made "), _whole(most), F.lit(" of "), _whole(F.col("retries")), F.lit(" retries.")
        ),
        "root_cause": F.concat(
            F.lit("Most retries come from tool "), tool, F.lit("; "), fixed(multiplier, 2).cast("string"), F.lit(" times the baseline. A loop or a missing stop rule is likely.")
        ),
        "recommendation": F.concat(
            F.lit("Find the loop in session "), session, F.lit(", give "), tool, F.lit(" a retry limit with growing pauses, and check what it waits for.")
        ),
    }


def _long_turn() -> dict:
    turn = F.try_element_at(F.col("top_turns"), F.lit(1))
    slow, session, component = _or_unknown(turn["key"]), _or_unknown(turn["session_id"]), _or_unknown(turn["component_type"])
    return {
        "alert_type": "long_turn_hotspot",
        "fired": turn["value"] >= F.greatest(F.lit(1000.0), F.col("t_ms") * 0.6),
        "severe": turn["value"] >= F.col("t_ms") * 1.5,
        "turn_latency_ms": turn["value"], "threshold_ms": F.col("t_ms"),
        "primary_turn": slow, "primary_session": session, "primary_component": component,
        "phenomenon": F.concat(F.lit("Turn "), slow, F.lit(" of session "), session, F.lit(" averages "), _whole(turn["value"]), F.lit(" ms, the slowest turn.")),
        "root_cause": F.concat(F.lit("Component "), component, F.lit(" dominates the turn; one stalled step is likelier than a slow system.")),
        "recommendation": F.concat(
            F.lit("Compare the steps of turn "), slow, F.lit(", see what "), component, F.lit(" waits for, and limit the time of a turn.")
        ),
    }


ANALYZERS = (_error_spike, _token_anomaly, _latency, _session_hotspot, _retry_storm, _long_turn)


def _chosen(only: Sequence[str] = ()) -> list[dict]:
    found = [{"ord": F.lit(i), **analyzer()} for i, analyzer in enumerate(ANALYZERS)]
    return [f for f in found if not only or f["alert_type"] in only]


def _by_type(chosen: Sequence[dict], name: str, kind: str) -> Column:
    """A result column: each alert type's expression for its own rows, null for the others."""
    out = None
    for found in chosen:
        if name in EVIDENCE_LISTS:
            value = F.col(name) if name in EVIDENCE_OF[found["alert_type"]] else None
        else:
            value = found.get(name)
        if value is not None:
            mine = F.col("alert_type") == found["alert_type"]
            out = F.when(mine, value) if out is None else out.when(mine, value)
    return (F.lit(None) if out is None else out).cast(kind).alias(name)


def _confidence() -> Column:
    """Evidence-based score in 0.3..1 for a fired alert; weights and bounds are fixed values."""

    def part(value: Column, top: float) -> Column:
        return F.least(F.lit(top), F.coalesce(value, F.lit(0.0)))

    deviation = F.when(
        F.col("baseline_rate") > 0,
        F.greatest(F.lit(0.0), (F.col("error_rate") - F.col("baseline_rate")) / F.col("baseline_rate") / 5.0),
    )
    ratio = F.coalesce(F.nullif(F.col("ratio"), F.lit(0.0)), F.col("baseline_multiplier"))
    over = F.when(
        F.col("threshold_ms") > 0, F.greatest(F.lit(0.0), (F.col("p95_ms") - F.col("threshold_ms")) / (F.col("threshold_ms") * 3))
    )
    signals = sum((F.when(F.size(F.coalesce(F.col(n), F.array().cast(EVIDENCE_LISTS[n]))) > 0, 1).otherwise(0) for n in SIGNALS), F.lit(0))
    score = (
        F.lit(0.3)
        + part(deviation, 0.35)
        + part(F.when(ratio > 1, (ratio - 1) / 10.0), 0.3)
        + part(over, 0.3)
        + part(F.col("concentration") * 0.5, 0.3)
        + F.least(F.lit(0.15), signals * F.lit(0.03))
    )
    return fixed(F.least(F.lit(1.0), score), 2)


def analyze(wide: DataFrame, fired_only: bool = True, only: Sequence[str] = ()) -> DataFrame:
    """One row per scope and analyzer with severity, numbers, evidence lists and confidence."""
    chosen = _chosen(only)
    types = wide.withColumn("alert_type", F.explode(F.array(*[F.lit(found["alert_type"]) for found in chosen])))
    kinds = {"ord": "int", "fired": "boolean", "severe": "boolean", **NUMBERS, **{n: "string" for n in (*NAMES, *TEXTS)}, **EVIDENCE_LISTS}
    columns = {name: _by_type(chosen, name, kind) for name, kind in kinds.items()}
    out = types.select("scope", "alert_type", *columns.values()).withColumn("fired", F.coalesce("fired", F.lit(False)))
    out = out.withColumn("severity", F.when(F.col("fired"), F.when(F.col("severe"), "critical").otherwise("warning"))).drop("severe")
    out = out.withColumn("confidence", F.when(F.col("fired"), _confidence()))
    return out.where(F.col("fired")) if fired_only else out


def alerts(
    events: DataFrame, rules: Rules = Rules(), as_of=None, by: Sequence[str] = (), fired_only=True, approx=False, overrides=None, only=()
) -> DataFrame:
    wide = snapshot(events, rules, as_of, by, approx, only)
    return analyze(wide if overrides is None else override(wide, overrides), fired_only, only)


# Evidence list -> kind of entity its keys name.
ENTITY_LISTS = {
    "top_failure_sessions": "session", "top_retry_sessions": "session", "top_token_sessions": "session",
    "top_error_tools": "tool", "top_latency_tools": "tool", "top_tools": "tool", "top_retry_tools": "tool",
    "top_error_models": "model", "top_models": "model",
    "top_failure_components": "component",
}
ENTITY_KINDS = ("session", "tool", "model", "component", "turn")


def with_entities(found: DataFrame) -> DataFrame:
    """Add ``entities``: the distinct ``kind``/``key`` pairs an alert's evidence names."""
    text = "struct('{kind}' AS kind, trim({key}) AS key)"
    parts = [f"transform(coalesce({name}, array()), e -> {text.format(kind=kind, key='e.key')})" for name, kind in ENTITY_LISTS.items()]
    parts += [
        f"transform(coalesce(top_turns, array()), e -> {text.format(kind=kind, key=f'e.{key}')})"
        for kind, key in (("turn", "key"), ("session", "session_id"), ("component", "component_type"))
    ]
    gathered = f"array_sort(array_distinct(filter(concat({', '.join(parts)}), e -> e.key IS NOT NULL AND e.key NOT IN ('', 'unknown'))))"
    return found.withColumn("entities", F.expr(gathered))


def entities(found: DataFrame) -> DataFrame:
    return with_entities(found).select("scope", "alert_type", F.explode("entities").alias("e")).select("scope", "alert_type", "e.kind", "e.key")


def chains(found: DataFrame) -> DataFrame:
    """Alerts of one scope that share an entity, directly or through others.

    A scope has at most six alerts, so the components are found inside its row:
    every alert repeatedly takes the smallest label among the alerts it touches.
    """
    member = F.struct(
        F.when(F.col("severity") == "critical", 0).otherwise(1).alias("weight"), "ord", "alert_type", "confidence", "phenomenon", "entities"
    )
    grouped = with_entities(found.where(F.col("fired"))).groupBy("scope").agg(F.array_sort(F.collect_list(member)).alias("m"))
    spread = f"""aggregate(sequence(1, {len(ANALYZERS) - 1}), sequence(0, size(m) - 1), (labels, step) ->
        transform(sequence(0, size(m) - 1), i -> array_min(transform(
            filter(sequence(0, size(m) - 1), j -> i = j OR arrays_overlap(m[i].entities, m[j].entities)), j -> labels[j]))))"""
    labelled = grouped.where(F.size("m") > 1).withColumn("labels", F.expr(spread))
    chain = labelled.select("scope", "m", "labels", F.explode(F.array_distinct("labels")).alias("label")).select(
        "scope", F.expr("filter(m, (a, i) -> labels[i] = label)").alias("c")
    )
    shared = "aggregate(slice(c, 2, size(c)), c[0].entities, (keep, a) -> array_intersect(keep, a.entities))"
    out = chain.where(F.size("c") > 1).withColumn("shared_entities", F.expr(shared))
    names = F.array_join(F.expr("transform(c, a -> a.alert_type)"), " -> ")
    first_shared = F.array_join(
        F.array_compact(
            F.array(*[F.expr(f"concat('{kind}=', try_element_at(filter(shared_entities, e -> e.kind = '{kind}'), 1).key)") for kind in ENTITY_KINDS])
        ),
        ", ",
    )
    return out.select(
        "scope",
        F.size("c").alias("members"),
        names.alias("narrative"),
        F.expr("array_max(transform(c, a -> a.confidence))").alias("confidence"),
        "shared_entities",
        F.concat_ws(
            " ",
            F.when(F.size("shared_entities") > 0, F.concat(F.lit("Shared: "), first_shared, F.lit("."))),
            F.concat(F.lit("Chain: "), names, F.lit(".")),
            F.expr("concat('Starts with: ', c[0].phenomenon)"),
        ).alias("summary"),
    ).orderBy(F.col("confidence").desc(), "scope", "narrative")


def alert_events(found: DataFrame, scopes: DataFrame, checked_at: Column | None = None) -> DataFrame:
    """Alerts as event rows to append; a scope without an alert gets one OK row.

    ``scopes`` holds every scope that was checked (for instance the snapshot).
    """
    stamp = checked_at if checked_at is not None else F.current_timestamp()
    fired = cut(found.where(F.col("fired")))  # six rows per scope at most, read twice
    base = [
        stamp.alias("ts"),
        F.lit("alert").alias("event_kind"),
        F.lit("process").alias("event_category"),
        F.lit("internal.alert_check").alias("event_dataset"),
        F.lit("alert-and-diagnose").alias("service_name"),
        F.lit("alert_check").alias("operation_name"),
    ]
    rows = fired.select(
        "scope",
        *base,
        F.col("alert_type").alias("event_action"),
        F.lit("failure").alias("event_outcome"),
        F.col("severity").alias("alert_severity"),
        F.col("phenomenon").alias("alert_phenomenon"),
        F.col("root_cause").alias("alert_root_cause"),
        F.col("recommendation").alias("alert_recommendation"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("alert_type"), F.lit(": "), F.col("phenomenon")).alias("message"),
        F.coalesce(top_key("top_failure_sessions"), top_key("top_retry_sessions")).alias("conversation_id"),
        top_key("top_turns").alias("turn_id"),
        top_key("top_failure_components").alias("component_type"),
    )
    quiet = scopes.select("scope").distinct().join(fired.select("scope").distinct(), "scope", "left_anti")
    fine = quiet.select(
        "scope", *base, F.lit("alert_check_ok").alias("event_action"), F.lit("success").alias("event_outcome"), F.lit("No alerts triggered").alias("message")
    )
    return rows.unionByName(fine, allowMissingColumns=True)
