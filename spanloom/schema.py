"""The event table: one wide, closed schema shared by every source and plan.

A row is one log record, span, feedback item, alert, evaluation or audit entry.
Columns carry snake-case names; the dotted telemetry name is kept as metadata.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The telemetry field names and their types.
FIELDS = (
    ("ts", "timestamp", "@timestamp"),
    ("message", "string", "message"),
    ("event_action", "string", "event.action"),
    ("event_category", "string", "event.category"),
    ("event_kind", "string", "event.kind"),
    ("event_outcome", "string", "event.outcome"),
    ("event_duration", "bigint", "event.duration"),
    ("event_module", "string", "event.module"),
    ("event_dataset", "string", "event.dataset"),
    ("service_name", "string", "service.name"),
    ("service_version", "string", "service.version"),
    ("service_environment", "string", "service.environment"),
    ("host_agent_id", "string", "agent.id"),
    ("host_agent_name", "string", "agent.name"),
    ("host_agent_type", "string", "agent.type"),
    ("trace_id", "string", "trace.id"),
    ("span_id", "string", "span.id"),
    ("parent_id", "string", "parent.id"),
    ("transaction_id", "string", "transaction.id"),
    ("observer_product", "string", "observer.product"),
    ("observer_type", "string", "observer.type"),
    ("observer_version", "string", "observer.version"),
    ("ingest_error", "string", "observer.ingest_error"),
    ("host_name", "string", "host.name"),
    ("host_hostname", "string", "host.hostname"),
    ("host_os_platform", "string", "host.os.platform"),
    ("recommended_modules", "array<string>", "labels.recommended_modules"),
    ("ingest_mode", "string", "labels.ingest_mode"),
    ("unmapped", "map<string,string>", "labels.unmapped"),
    ("payload_truncated", "boolean", "labels.payload_truncated"),
    ("gen_ai_system", "string", "gen_ai.system"),
    ("request_model", "string", "gen_ai.request.model"),
    ("response_model", "string", "gen_ai.response.model"),
    ("operation_name", "string", "gen_ai.operation.name"),
    ("input_tokens", "bigint", "gen_ai.usage.input_tokens"),
    ("output_tokens", "bigint", "gen_ai.usage.output_tokens"),
    ("total_tokens", "bigint", "gen_ai.usage.total_tokens"),
    ("agent_id", "string", "gen_ai.agent.id"),
    ("agent_name", "string", "gen_ai.agent.name"),
    ("agent_version", "string", "gen_ai.agent.version"),
    ("conversation_id", "string", "gen_ai.conversation.id"),
    ("tool_name", "string", "gen_ai.tool.name"),
    ("tool_call_id", "string", "gen_ai.tool.call.id"),
    ("error_type", "string", "error.type"),
    ("turn_id", "string", "gen_ai.agent_ext.turn_id"),
    ("component_type", "string", "gen_ai.agent_ext.component_type"),
    ("retry_count", "int", "gen_ai.agent_ext.retry_count"),
    ("latency_ms", "double", "gen_ai.agent_ext.latency_ms"),
    ("cost", "double", "gen_ai.agent_ext.cost"),
    ("module", "string", "gen_ai.agent_ext.module"),
    ("module_kind", "string", "gen_ai.agent_ext.module_kind"),
    ("semantic_kind", "string", "gen_ai.agent_ext.semantic_kind"),
    ("verify_id", "string", "gen_ai.agent_ext.verify_id"),
    ("retrieval_latency_ms", "double", "gen_ai.agent_ext.retrieval_latency_ms"),
    ("cache_hit", "boolean", "gen_ai.agent_ext.cache_hit"),
    ("retrieval_score", "double", "gen_ai.agent_ext.retrieval_score"),
    ("knowledge_source", "string", "gen_ai.agent_ext.knowledge_source"),
    ("guardrail_action", "string", "gen_ai.guardrail.action"),
    ("guardrail_rule_id", "string", "gen_ai.guardrail.rule_id"),
    ("guardrail_category", "string", "gen_ai.guardrail.category"),
    ("guardrail_latency_ms", "double", "gen_ai.guardrail.latency_ms"),
    ("evaluation_run_id", "string", "gen_ai.evaluation.run_id"),
    ("evaluation_evaluator", "string", "gen_ai.evaluation.evaluator"),
    ("evaluation_score", "double", "gen_ai.evaluation.score"),
    ("evaluation_outcome", "string", "gen_ai.evaluation.outcome"),
    ("evaluation_dimension", "string", "gen_ai.evaluation.dimension"),
    ("parent_agent_id", "string", "gen_ai.agent_ext.parent_agent.id"),
    ("trigger_span_id", "string", "gen_ai.agent_ext.causality.trigger_span_id"),
    ("delegation_target", "string", "gen_ai.agent_ext.delegation_target"),
    ("reasoning_action", "string", "gen_ai.agent_ext.reasoning.action"),
    ("reasoning_alternatives", "string", "gen_ai.agent_ext.reasoning.alternatives"),
    ("reasoning_rationale", "string", "gen_ai.agent_ext.reasoning.rationale"),
    ("reasoning_confidence", "double", "gen_ai.agent_ext.reasoning.confidence"),
    ("reasoning_input_summary", "string", "gen_ai.agent_ext.reasoning.input_summary"),
    ("reasoning_decision_type", "string", "gen_ai.agent_ext.reasoning.decision_type"),
    ("reasoning_step_index", "int", "gen_ai.agent_ext.reasoning.step_index"),
    ("feedback_score", "double", "gen_ai.feedback.score"),
    ("feedback_sentiment", "string", "gen_ai.feedback.sentiment"),
    ("feedback_comment", "string", "gen_ai.feedback.comment"),
    ("feedback_trace_id", "string", "gen_ai.feedback.trace_id"),
    ("feedback_session_id", "string", "gen_ai.feedback.session_id"),
    ("feedback_user_id", "string", "gen_ai.feedback.user_id"),
)

# Columns that travel with a row but that no aggregate reads by default.
CARRIED = (
    ("log_level", "string", "log.level"),
    ("log_body", "string", "log.body"),
    ("severity_number", "int", "log.severity_number"),
    ("span_name", "string", "span.name"),
    ("span_kind", "string", "span.kind"),
    ("otel_signal", "string", "otel.signal"),
    ("otel_scope_name", "string", "otel.scope.name"),
    ("otel_scope_version", "string", "otel.scope.version"),
    ("alert_severity", "string", "alert.severity"),
    ("alert_phenomenon", "string", "alert.phenomenon"),
    ("alert_root_cause", "string", "alert.root_cause"),
    ("alert_recommendation", "string", "alert.recommendation"),
    ("audit_verdict", "string", "audit.verdict"),
    ("audit_duration_ms", "double", "audit.duration_ms"),
    ("audit_inputs", "map<string,string>", "audit.inputs"),
    ("audit_evidence", "map<string,string>", "audit.evidence"),
)

# Roots that a structured message may fill.
KNOWN_ROOTS = (
    "@timestamp", "message", "event", "service", "agent", "trace", "span", "parent",
    "transaction", "observer", "host", "labels", "gen_ai", "error", "log",
)

# Payload fields that never reach the event table.
SENSITIVE = (
    "gen_ai.prompt", "gen_ai.completion", "gen_ai.tool.call.arguments", "gen_ai.tool.call.result",
)

# Longest text kept, in characters.
MAX_TEXT = {
    "reasoning_rationale": 500,
    "reasoning_input_summary": 300,
    "feedback_comment": 1000,
}

# Fields whose presence is scored, with their tier.
COVERAGE_TIERS = {
    "tool_name": 2,
    "conversation_id": 2,
    "turn_id": 2,
    "component_type": 2,
    "retry_count": 3,
    "error_type": 3,
    "cost": 3,
    "reasoning_action": 3,
    "feedback_score": 3,
}

PARTITION_COLUMN = "event_date"

DOTTED = {name: dotted for name, _, dotted in FIELDS + CARRIED}
COLUMN_TYPES = {name: kind for name, kind, _ in FIELDS + CARRIED}


def event_schema() -> T.StructType:
    """Declared schema of the stored table, dotted names as column metadata."""
    return T.StructType(
        [
            T.StructField(
                name,
                T._parse_datatype_string(kind),
                True,
                {"field": dotted, "tier": COVERAGE_TIERS.get(name, 1)},
            )
            for name, kind, dotted in FIELDS + CARRIED
        ]
    )


def ddl(fields=FIELDS + CARRIED) -> str:
    """The same schema as a DDL string, usable before a session exists."""
    return ", ".join(f"{name} {kind}" for name, kind, _ in fields)
