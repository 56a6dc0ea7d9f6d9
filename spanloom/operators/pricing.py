"""Model -> price matching and per-call cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRICE = "decimal(12,6)"


def model_key(model: Column) -> Column:
    return F.trim(F.lower(model))


def inline_price(model: Column, table: Mapping[str, tuple[float, float]]) -> Column:
    """Price struct of the longest pattern the model starts with; an exact name is the longest.

    An empty pattern prices nothing.
    """
    key = model_key(model)
    found = F.when(F.lit(False), F.lit(None).cast(f"struct<pattern:string,price_in:{_PRICE},price_out:{_PRICE}>"))
    for pattern in sorted(filter(None, table), key=lambda p: (-len(p), p)):
        low, high = table[pattern]
        price = F.struct(
            F.lit(pattern).alias("pattern"),
            F.lit(str(low)).cast(_PRICE).alias("price_in"),
            F.lit(str(high)).cast(_PRICE).alias("price_out"),
        )
        found = found.when(key.startswith(pattern), price)
    return found


def match_models(models: DataFrame, price_rows: DataFrame, model: str = "request_model") -> DataFrame:
    """The same for a price table that is a table: equi-join on every prefix of each distinct model."""
    distinct = models.where(F.col(model).isNotNull()).select(F.col(model)).distinct()
    prefixes = distinct.select(
        model, F.explode(F.expr(f"transform(sequence(1, greatest(length(trim(lower({model}))), 1)), n -> left(trim(lower({model})), n))")).alias("pattern")
    )
    hits = prefixes.where("pattern <> ''").join(price_rows, "pattern").groupBy(model).agg(
        F.max_by(F.struct("pattern", "price_in", "price_out"), F.length("pattern")).alias("_price")
    )
    return distinct.join(hits, model, "left").select(model, "_price")


def with_price(
    df: DataFrame, table: Mapping[str, tuple[float, float]] | DataFrame, model: str = "request_model"
) -> DataFrame:
    """Add ``_price`` (null for an unpriced model)."""
    if isinstance(table, DataFrame):
        return df.join(match_models(df, table, model), model, "left")  # one row per distinct model
    return df.withColumn("_price", inline_price(F.col(model), table))


def call_cost(price: str = "_price", tokens_in: str = "input_tokens", tokens_out: str = "output_tokens") -> Column:
    """USD of one call, eight digits, null when unpriced."""

    def tokens(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("decimal(15,0)")

    per_million = tokens(tokens_in) * F.col(price)["price_in"] + tokens(tokens_out) * F.col(price)["price_out"]
    return F.round(per_million * F.lit("0.000001").cast("decimal(7,6)"), 8).cast("double")
