"""Ingest normalisation as one chain of column expressions, the same for batch and stream.

Order: explicit value, then the value found in a structured message, then the
derived default. Sensitive payloads are dropped from the attributes and from the
message text; nothing here needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CARRIED, COLUMN_TYPES, DOTTED, FIELDS, KNOWN_ROOTS, MAX_TEXT, SENSITIVE

PRODUCT = "spanloom"
OBSERVER_TYPE = "event-normaliser"
TRUNCATED = "... [truncated]"

_NESTED = "map<string,variant>"
_SCALARS = {name: kind for name, kind, _ in FIELDS + CARRIED if "<" not in kind}


def _opened(entries: str) -> str:
    """Entries with objects replaced by their members, keys joined with a dot."""
    members = f"try_variant_get(e.value, '$', '{_NESTED}')"
    return (
        f"flatten(transform({entries}, e -> if({members} IS NULL, array(e), "
        f"transform(map_entries({members}), m -> named_struct('key', concat(e.key, '.', m.key), 'value', m.value)))))"
    )


def with_map(df: DataFrame, entries: str, into: str) -> DataFrame:
    """Turn a column of (key, value) entries into a map; the first of equal keys wins."""
    keyed = df.withColumn("_keys", F.expr(f"transform({entries}, e -> e.key)"))
    firsts = f"map_from_entries(filter({entries}, (e, i) -> array_position(_keys, e.key) = i + 1))"
    return keyed.withColumn(into, F.expr(firsts)).drop("_keys", entries)


def message_fields(df: DataFrame, message: str = "message", into: str = "_flat") -> DataFrame:
    """Add a map of dotted name -> variant for messages that hold a JSON object.

    Known roots are opened three levels deep (four name parts); a fourth-level value,
    a dotted root and an unknown root are kept as they are. Anything but a JSON
    object gives null.
    """
    roots = ", ".join(f"'{root}'" for root in KNOWN_ROOTS)
    parsed = F.when(F.ltrim(F.col(message)).startswith("{"), F.try_parse_json(F.col(message)))
    top = df.withColumn("_top", F.map_entries(F.try_variant_get(parsed, "$", _NESTED)))
    known = "filter(_top, e -> e.key IN ({roots}))".format(roots=roots)
    closed = "filter(_top, e -> e.key NOT IN ({roots}))".format(roots=roots)
    entries = top.withColumn("_entries", F.expr(f"concat({closed}, {_opened(_opened(_opened(known)))})"))
    return with_map(entries.drop("_top"), "_entries", into)


def is_sensitive(key: Column) -> Column:
    hit = F.lit(False)
    for name in SENSITIVE:
        hit = hit | (key == name) | key.startswith(f"{name}.")
    return hit


def _from_message(name: str, kind: str) -> str:
    return f"try_cast(_flat['{DOTTED[name]}'] AS {kind})"


def _unreadable() -> Column:
    """Names of message fields whose value does not fit the declared type."""
    found = [
        f"if(_flat['{DOTTED[name]}'] IS NOT NULL AND NOT is_variant_null(_flat['{DOTTED[name]}']) "
        f"AND {_from_message(name, kind)} IS NULL, '{DOTTED[name]}', NULL)"
        for name, kind in _SCALARS.items()
        if kind != "string"
    ]
    names = F.expr(f"array_compact(array({', '.join(found)}))")
    return F.when(F.size(names) > 0, F.concat(F.lit("unreadable value: "), F.array_join(names, ", ")))


def truncate(column: Column, limit: int) -> Column:
    return F.when(F.length(column) > limit, F.concat(F.left(column, F.lit(limit)), F.lit(TRUNCATED))).otherwise(column)


def duration_from_latency(latency_ms: Column) -> Column:
    """Nanoseconds from milliseconds, cut towards zero."""
    return (latency_ms * F.lit(1_000_000.0)).cast("bigint")


def outcome_from_error(error_type: Column) -> Column:
    return F.when(error_type.isNotNull(), "failure").otherwise("success")


def declared_names() -> Column:
    """The dotted names that have a column, as one constant array."""
    return F.expr("array(" + ", ".join(f"'{name}'" for name in DOTTED.values()) + ")")


def unmapped_fields(flat: str = "_flat") -> Column:
    """Message fields without a column, as text; null when there are none."""
    declared = declared_names()
    rest = F.map_filter(F.col(flat), lambda k, v: ~F.array_contains(declared, k) & ~is_sensitive(k) & ~F.is_variant_null(v))
    text = F.transform_values(rest, lambda k, v: v.cast("string"))
    return F.when(F.size(text) > 0, text)


def redacted_message(message: Column, flat: str = "_flat") -> Column:
    """Message text; one that carries a sensitive field is written again without it."""
    carries = F.coalesce(F.exists(F.map_keys(F.col(flat)), is_sensitive), F.lit(False))
    clean = F.to_json(F.transform_values(F.map_filter(F.col(flat), lambda k, v: ~is_sensitive(k)), lambda k, v: v))
    return F.when(carries, clean).otherwise(message)


def normalize(
    df: DataFrame,
    modules: Sequence[str] = (),
    product: str = PRODUCT,
    observer_type: str = OBSERVER_TYPE,
    resource: dict[str, str] | None = None,
    ingest_ts: Column | None = None,
) -> DataFrame:
    """Rows in the closed event schema.

    ``df`` may hold any of the event columns. ``resource`` values (column -> text)
    override what the rows carry, as a collector's resource upsert does.
    """
    now = ingest_ts if ingest_ts is not None else F.current_timestamp()
    given = df.selectExpr(*typed_columns(df.columns))
    flat = message_fields(given)
    merged = flat.selectExpr(
        *[
            f"coalesce({name}, {_from_message(name, kind)}) AS {name}" if name in _SCALARS and name != "message" else name
            for name, kind, _ in FIELDS + CARRIED
        ],
        "_flat",
    ).withColumn("_unreadable", _unreadable())
    columns: dict[str, Column] = {}
    columns["ts"] = F.coalesce("ts", now.cast("timestamp"))
    columns["event_kind"] = F.coalesce("event_kind", F.lit("event"))
    columns["event_category"] = F.coalesce("event_category", F.lit("process"))
    columns["event_duration"] = F.coalesce("event_duration", duration_from_latency(F.col("latency_ms")))
    columns["event_outcome"] = F.coalesce("event_outcome", outcome_from_error(F.col("error_type")))
    columns["observer_product"] = F.lit(product)
    columns["observer_type"] = F.lit(observer_type)
    columns["recommended_modules"] = F.array(*[F.lit(m) for m in modules]).cast("array<string>")
    columns["ingest_error"] = F.coalesce("ingest_error", "_unreadable")
    columns["unmapped"] = _merged_maps(F.col("unmapped"), unmapped_fields())
    columns["message"] = redacted_message(F.col("message"))
    for name, limit in MAX_TEXT.items():
        columns[name] = truncate(F.col(name), limit)
    for name, value in (resource or {}).items():
        columns[name] = F.lit(value).cast(COLUMN_TYPES[name])
    return merged.withColumns(columns).drop("_flat", "_unreadable")


def typed_columns(have: Sequence[str]) -> list[str]:
    """One expression per schema column: the column in its declared type, or null."""
    return [f"CAST({name if name in have else 'NULL'} AS {kind}) AS {name}" for name, kind, _ in FIELDS + CARRIED]


def _merged_maps(first: Column, second: Column) -> Column:
    """Both maps; on equal keys the first wins."""
    rest = F.map_filter(second, lambda k, v: ~F.array_contains(F.map_keys(first), k))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(first, rest))
