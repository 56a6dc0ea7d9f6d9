"""Token cost: price match, backfill of rows without a cost, and breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_if, fixed, keep_external, money, total
from ..functions.timeframe import at_least
from ..operators.facets import facet_counts, ranked_lists, terms
from ..operators.pricing import call_cost, model_key, with_price
from ..sources.prices import prices


def price_match(events: DataFrame, table=None) -> DataFrame:
    """Models seen, with the price pattern each one falls under."""
    models = events.where(F.col("request_model").isNotNull()).groupBy("request_model").agg(F.count(F.lit(1)).alias("calls"))
    priced = with_price(models, table if table is not None else prices())
    return priced.select(
        "request_model",
        "calls",
        F.col("_price.pattern").alias("pattern"),
        F.col("_price.price_in").cast("double").alias("price_in"),
        F.col("_price.price_out").cast("double").alias("price_out"),
    )


def _needs_cost(events: DataFrame, time_range: str, as_of):
    return (
        at_least(events, time_range, as_of)
        & F.col("input_tokens").isNotNull()
        & F.col("request_model").isNotNull()
        & F.col("cost").isNull()
    )


def backfill(events: DataFrame, time_range: str = "now-24h", as_of=None, table=None) -> DataFrame:
    """The event rows with missing costs filled in where the model has a price."""
    priced = with_price(events, table if table is not None else prices())
    filled = F.when(_needs_cost(events, time_range, as_of), call_cost()).otherwise(F.col("cost"))
    return priced.withColumn("cost", filled).select(*events.columns)


def backfill_summary(events: DataFrame, time_range: str = "now-24h", as_of=None, table=None) -> DataFrame:
    """Per model: rows that lack a cost, rows that can be priced and the cost they get."""
    rows = events.where(_needs_cost(events, time_range, as_of))
    priced = with_price(rows, table if table is not None else prices()).withColumn("_new", call_cost())
    return priced.groupBy(F.trim("request_model").alias("model")).agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.count("_new").alias("enriched"),
        total(money("_new")).cast("double").alias("cost_added"),
    )


def unpriced_models(events: DataFrame, time_range: str = "now-24h", as_of=None, table=None) -> DataFrame:
    summary = backfill_summary(events, time_range, as_of, table)
    return summary.where(F.col("enriched") == 0).select("model").orderBy("model")


def _costed(events: DataFrame, time_range: str, as_of) -> DataFrame:
    return keep_external(events, "all").where(at_least(events, time_range, as_of) & F.col("cost").isNotNull())


def total_cost(events: DataFrame, time_range: str = "now-24h", as_of=None) -> DataFrame:
    return _costed(events, time_range, as_of).agg(
        fixed(total(money("cost")), 6).alias("total_cost_usd"), F.count("cost").alias("calls")
    )


def cost_by(events: DataFrame, key: str, size: int, time_range: str = "now-24h", as_of=None) -> DataFrame:
    """Top keys by cost; six digits, as reported."""
    rows = _costed(events, time_range, as_of)
    ranked = terms(rows, key, size, order="raw", raw=F.sum(money("cost")))
    return ranked.select(F.col(key).alias("name"), fixed(F.col("raw"), 6).alias("cost"), F.col("count").alias("calls"))


def summary(events: DataFrame, time_range: str = "now-24h", as_of=None) -> DataFrame:
    """All three breakdowns from one scan: ``breakdown, rank, name, cost, calls``."""
    rows = _costed(events, time_range, as_of).select("cost", "request_model", "tool_name", "conversation_id")
    counts = facet_counts(
        rows, {"model": "request_model", "tool": "tool_name", "session": "conversation_id"}, cost=F.sum(money("cost"))
    )
    lists = {"by_model": ("model", "cost"), "by_tool": ("tool", "cost"), "by_session": ("session", "cost")}
    ranked = ranked_lists(counts, lists, 20)
    limit = F.when(F.col("list") == "by_session", 10).otherwise(20)
    return ranked.where(F.col("rank") <= limit).select(
        F.col("list").alias("breakdown"), "rank", F.col("key").alias("name"), fixed(F.col("value"), 6).alias("cost"),
        F.col("count").alias("calls"),
    )
