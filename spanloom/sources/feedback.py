"""User feedback rows as events, and feedback joined to what it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = (
    "score string, sentiment string, comment string, trace_id string, session_id string, user_id string, "
    "service_name string"
)


def sentiment(score: Column, neutral_at: float = 0.0) -> Column:
    """From the sign of the score; ``neutral_at`` moves the middle for 1..5 scales."""
    value = score.try_cast("double")
    return F.when(value > neutral_at, "positive").when(value < neutral_at, "negative").when(value == neutral_at, "neutral")


def feedback_events(rows: DataFrame, received: Column | None = None, neutral_at: float = 0.0) -> DataFrame:
    def given(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit(""))

    score = F.col("score").cast("string")
    return rows.select(
        (received if received is not None else F.current_timestamp()).alias("ts"),
        F.lit("event").alias("event_kind"),
        F.lit("process").alias("event_category"),
        F.lit("user_feedback").alias("event_action"),
        F.lit("feedback").alias("event_dataset"),
        F.lit("success").alias("event_outcome"),
        F.coalesce(given("service_name"), F.lit("user-feedback")).alias("service_name"),
        F.lit("feedback").alias("operation_name"),
        score.try_cast("double").alias("feedback_score"),
        F.coalesce(given("sentiment"), sentiment(score, neutral_at)).alias("feedback_sentiment"),
        given("comment").alias("feedback_comment"),
        given("comment").alias("message"),
        given("trace_id").alias("feedback_trace_id"),
        given("trace_id").alias("trace_id"),
        given("session_id").alias("feedback_session_id"),
        given("session_id").alias("conversation_id"),
        given("user_id").alias("feedback_user_id"),
    )


def read_feedback(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(FEEDBACK).options(**options)
    return feedback_events(reader.json(path))


def feedback_on(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Score totals per trace, and per session for feedback without a trace, next to the event counts.

    Both sides are aggregated to their key before they meet.
    """
    key = F.coalesce(F.concat(F.lit("trace:"), F.col("trace_id")), F.concat(F.lit("session:"), F.col("conversation_id")))
    scored = (
        feedback.where(F.col("feedback_score").isNotNull())
        .withColumn("about", key)
        .where(F.col("about").isNotNull())
        .groupBy("about")
        .agg(F.count(F.lit(1)).alias("scores"), F.sum(F.col("feedback_score").cast("decimal(20,6)")).cast("double").alias("score_sum"))
    )
    keys = F.array_compact(
        F.array(F.concat(F.lit("trace:"), F.col("trace_id")), F.concat(F.lit("session:"), F.col("conversation_id")))
    )
    seen = events.select(F.explode(keys).alias("about")).groupBy("about").agg(F.count(F.lit(1)).alias("events"))
    return scored.join(seen, "about", "left").select("about", "scores", "score_sum", F.coalesce("events", F.lit(0)).alias("events"))
