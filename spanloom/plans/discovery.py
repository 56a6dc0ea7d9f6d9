"""Workspace discovery over a table of text files: ``workspace, path, content``.

Rules are a parameter (see ``load_rules``): per module kind a priority, keywords for
paths and for contents, and the signals the kind emits. All keywords are tested in
one pass over each text, without a join.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_keyword, normalize_text

PATH_POINTS = 5
CONTENT_POINTS = 3
HANDLER_POINTS = 4
HANDLERS = "command_handlers"
HANDLER_PRIORITY = 89
HANDLER_SIGNALS = ("command_calls", "command_errors", "command_latency")
# Fixed value: command handlers are functions that are named so.
HANDLER_PATTERN = r"def\s+(cmd_[a-zA-Z0-9_]+)\s*\("


# What each kind of module is told by, when no rules are given: priority, words in paths, words in texts, signals.
OWN_RULES = {
    "model_calls": (90, ("llm", "completion"), ("chat.completions", "generate(", "temperature"), ("call_count", "call_latency", "token_usage")),
    "retrieval": (80, ("retriev", "vector", "embed"), ("similarity search", "top_k", "embedding"), ("retrieval_latency", "retrieval_hits")),
    "tool_use": (75, ("tool", "plugin"), ("tool_call", "function call"), ("tool_calls", "tool_errors")),
    "guard": (70, ("guard", "policy"), ("moderation", "blocked", "redact"), ("blocked_requests",)),
    "memory": (60, ("memory", "history"), ("conversation history", "session state"), ("memory_reads", "memory_writes")),
    "planning": (55, ("planner", "reason"), ("next step", "chain of thought"), ("plan_steps",)),
    "serving": (40, ("server", "api", "route"), ("fastapi", "flask", "endpoint"), ("request_rate", "request_errors")),
    "scheduling": (30, ("cron", "queue", "worker"), ("schedule", "enqueue"), ("queue_depth",)),
}


def load_rules(source: str | Mapping | None = None) -> dict[str, dict]:
    """Rules from JSON text or a mapping ``{kind: {priority, path_keywords, content_keywords, signals}}``; else an own set."""
    if source is None:
        parts = ("priority", "path_keywords", "content_keywords", "signals")
        source = {kind: dict(zip(parts, rule)) for kind, rule in OWN_RULES.items()}
    given = json.loads(source) if isinstance(source, str) else source
    return {
        kind: {
            "priority": int(rule.get("priority", 0)),
            "path_keywords": [str(k).lower() for k in rule.get("path_keywords", ())],
            "content_keywords": [str(k).lower() for k in rule.get("content_keywords", ())],
            "signals": list(rule.get("signals", ())),
        }
        for kind, rule in given.items()
    }


def _score(rule: Mapping) -> Column:
    points = [F.when(F.col("_path").contains(k), PATH_POINTS).otherwise(0) for k in rule["path_keywords"]]
    points += [F.when(has_keyword(F.col("_text"), k), CONTENT_POINTS).otherwise(0) for k in rule["content_keywords"]]
    return sum(points, F.lit(0))


def _handler_names() -> Column:
    return F.array_distinct(F.regexp_extract_all("content", F.lit(HANDLER_PATTERN), F.lit(1)))


def evidence(files: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """All evidence from one read of the texts: ``workspace, path, module_kind, score, handler``.

    ``handler`` is set on the rows of command handlers only, one per name and file.
    """
    read = files.select(
        "workspace", "path", "content", F.lower("path").alias("_path"), F.lower(normalize_text(F.col("content"))).alias("_text")
    )
    none = F.lit(None).cast("string")
    scored = F.array(
        *[F.struct(F.lit(kind).alias("module_kind"), _score(rule).alias("score"), none.alias("handler")) for kind, rule in rules.items()]
    )
    handlers = F.transform(
        _handler_names(),
        lambda name: F.struct(F.lit(HANDLERS).alias("module_kind"), F.lit(HANDLER_POINTS).alias("score"), name.alias("handler")),
    )
    return (
        read.select("workspace", "path", F.explode(F.concat(scored, handlers)).alias("e"))
        .select("workspace", "path", "e.module_kind", "e.score", "e.handler")
        .where(F.col("score") > 0)
    )


def file_scores(files: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """``workspace, path, module_kind, score`` for every file that scores under a rule."""
    return evidence(files, rules).where(F.col("handler").isNull()).drop("handler")


def command_handlers(files: DataFrame) -> DataFrame:
    """Handlers defined per file: ``workspace, path, handler``."""
    return files.select("workspace", "path", F.explode(_handler_names()).alias("handler"))


def _by_kind(rules: Mapping[str, Mapping], value: str, kind: str) -> Column:
    """Constant of each kind, as a column over ``module_kind``."""
    found = None
    for name, rule in rules.items():
        constant = F.array(*[F.lit(s) for s in rule[value]]).cast("array<string>") if value == "signals" else F.lit(rule[value])
        test = F.col(kind) == name
        found = F.when(test, constant) if found is None else found.when(test, constant)
    return found


def modules(files: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """Detected modules: ``workspace, module_kind, score, evidence_files, handlers, priority, signals``."""
    known = dict(rules)
    known[HANDLERS] = {"priority": HANDLER_PRIORITY, "signals": HANDLER_SIGNALS}
    counted = (
        evidence(files, rules)
        .groupBy("workspace", "module_kind")
        .agg(
            F.sum("score").alias("score"),
            F.count_distinct("path").alias("evidence_files"),
            F.count_distinct("handler").alias("handlers"),
        )
    )
    return counted.withColumn("priority", _by_kind(known, "priority", "module_kind")).withColumn(
        "signals", _by_kind(known, "signals", "module_kind")
    )


def monitoring_plan(found: DataFrame) -> DataFrame:
    """Modules by priority, then name, with the reason."""
    why = F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(" from "), F.col("evidence_files").cast("string"), F.lit(" file(s)"))
    return found.withColumn("why", why).orderBy("workspace", F.col("priority").desc(), "module_kind")


def profile(found: DataFrame) -> DataFrame:
    """One row per workspace: its kinds, signals and number of distinct handlers."""
    return found.groupBy("workspace").agg(
        F.array_sort(F.collect_set("module_kind")).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"),
        F.sum("handlers").alias("handlers"),
    )


def _kind(*names: str) -> Column:
    return F.arrays_overlap(F.col("kinds"), F.array(*[F.lit(n) for n in names]))


def _signal(*names: str) -> Column:
    return F.arrays_overlap(F.col("signals"), F.array(*[F.lit(n) for n in names]))


def architecture_style(profiles: DataFrame) -> DataFrame:
    # The three styles.
    style = (
        F.when(_kind("agent_manifest") & _kind("runtime_entrypoint") & (F.col("handlers") > 0), "single-script skill with command surface")
        .when(_kind("workflow_orchestrator") & _kind("tool_registry"), "multi-stage orchestrated agent")
        .otherwise("mixed agent workspace")
    )
    return profiles.withColumn("architecture_style", style)


# Fixed values: (points, kinds, signals) per dimension with its cap.
MATURITY = {
    "basic_logging": (15, [(8, ("runtime_entrypoint",), ()), (4, ("agent_manifest",), ()), (3, (), ("runs", "errors", "turns"))]),
    "structured_telemetry": (
        25,
        [
            (10, ("existing_observability",), ()), (10, ("otel_sdk_surface",), ()), (5, ("elastic_apm",), ()),
            (5, (), ("otlp_ingest", "otel_semantics", "trace_bridge")),
        ],
    ),
    "genai_instrumentation": (
        25,
        [(10, ("model_adapter",), ()), (8, ("tool_registry",), ()), (4, (), ("token_usage", "cost")), (3, (), ("tool_latency", "tool_errors"))],
    ),
    "operational_readiness": (
        20, [(7, ("mcp_surface",), ()), (5, ("command_surface", HANDLERS), ()), (4, ("evaluation_harness",), ()), (4, ("memory_store",), ())],
    ),
}
DEPTH_CAP, SIGNAL_CAP, HANDLER_CAP = 15, 10, 5
LEVELS = ((80, "advanced"), (50, "intermediate"), (25, "basic"))


def maturity(profiles: DataFrame) -> DataFrame:
    """Score 0..100 in five capped dimensions, and its level."""
    out = profiles
    for name, (cap, parts) in MATURITY.items():
        points = F.lit(0)
        for worth, kinds, signals in parts:
            test = _kind(*kinds) if kinds else _signal(*signals)
            points = points + F.when(test, worth).otherwise(0)
        out = out.withColumn(name, F.least(F.lit(cap), points))
    depth = F.least(F.lit(SIGNAL_CAP), F.size("signals")) + F.least(F.lit(HANDLER_CAP), F.col("handlers")).cast("int")
    out = out.withColumn("depth_bonus", F.least(F.lit(DEPTH_CAP), depth))
    total = sum((F.col(name) for name in (*MATURITY, "depth_bonus")), F.lit(0))
    level = F.lit("minimal")
    for bound, name in reversed(LEVELS):
        level = F.when(total >= bound, name).otherwise(level)
    return out.select("workspace", total.alias("score"), level.alias("level"), *MATURITY, "depth_bonus")


# Ingest modes, their score and what speaks for them.
INGEST_MODES = (
    ("collector", 0.94, (), ()),
    (
        "apm-otlp-hybrid", 0.88,
        ("existing_observability", "otel_sdk_surface", "elastic_apm", "browser_frontend", "web_service"),
        ("otlp_ingest", "trace_bridge", "frontend_trace_correlation", "distributed_tracing"),
    ),
    ("elastic-agent-fleet", 0.82, ("runtime_entrypoint", "tool_registry", "elastic_agent"), ()),
)


def ingest_modes(profiles: DataFrame) -> DataFrame:
    """Recommended modes per workspace, best first; the collector always applies."""
    options = []
    for mode, score, kinds, signals in INGEST_MODES:
        test = F.lit(not kinds and not signals)
        if kinds:
            test = test | _kind(*kinds)
        if signals:
            test = test | _signal(*signals)
        options.append(F.when(test, F.struct(F.lit(mode).alias("mode"), F.lit(score).alias("score"))))
    return profiles.select("workspace", F.explode(F.array_compact(F.array(*options))).alias("m")).select("workspace", "m.mode", "m.score")


# Packages and imports that give a framework away, in order of preference.
FRAMEWORKS = {
    "autogen": (("pyautogen", "autogen-agentchat", "autogen"), ("autogen", "autogen.agentchat")),
    "crewai": (("crewai",), ("crewai",)),
    "langgraph": (("langgraph", "langchain"), ("langgraph", "langchain")),
    "openai-agents": (("openai-agents", "agents"), ("agents",)),
    "llamaindex": (("llama-index", "llama_index"), ("llama_index",)),
    "openclaw": (("openclaw",), ("openclaw",)),
    "mastra": (("@mastra/core",), ("@mastra",)),
}
MANIFESTS = ("requirements.txt", "pyproject.toml", "setup.cfg", "Pipfile")


def frameworks(files: DataFrame, signatures: Mapping[str, tuple] = FRAMEWORKS) -> DataFrame:
    """The framework of each workspace: manifests first, then package.json, then Python imports.

    Each file proposes its first matching signature together with its own rank; the
    smallest proposal of a workspace wins, so nothing is gathered.
    """
    content, lower = F.col("content"), F.col("_lower")
    rank = F.array_position(F.array(*[F.lit(m) for m in MANIFESTS]), F.col("path"))
    packages = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    names = F.transform(
        F.concat(
            F.coalesce(F.map_keys(packages["dependencies"]), F.array().cast("array<string>")),
            F.coalesce(F.map_keys(packages["devDependencies"]), F.array().cast("array<string>")),
        ),
        F.lower,
    )

    def first_match(test) -> Column:
        found = None
        for order, (name, signature) in enumerate(signatures.items()):
            value = F.struct(F.lit(order).alias("order"), F.lit(name).alias("framework"))
            hit = test(signature)
            found = F.when(hit, value) if found is None else found.when(hit, value)
        return found

    def any_of(tests) -> Column:
        out = F.lit(False)
        for test in tests:
            out = out | test
        return out

    in_manifest = first_match(lambda s: any_of(lower.contains(p.lower()) for p in s[0]))
    in_packages = first_match(lambda s: any_of(F.array_contains(names, p.lower()) for p in s[0]))
    in_imports = first_match(lambda s: any_of(content.contains(f"import {i}") | content.contains(f"from {i}") for i in s[1]))
    stage = (
        F.when(rank > 0, F.struct(F.lit(1).alias("stage"), F.format_string("%04d", rank).alias("file"), in_manifest.alias("hit")))
        .when(F.col("path") == "package.json", F.struct(F.lit(2).alias("stage"), F.col("path").alias("file"), in_packages.alias("hit")))
        .when(F.col("path").endswith(".py"), F.struct(F.lit(3).alias("stage"), F.col("path").alias("file"), in_imports.alias("hit")))
    )
    proposals = (
        files.withColumn("_lower", F.lower("content")).select("workspace", stage.alias("s")).where(F.col("s.hit").isNotNull())
    )
    return proposals.groupBy("workspace").agg(F.min("s").alias("s")).select(
        "workspace", F.col("s.hit.framework").alias("framework"), F.col("s.stage").alias("stage")
    )
