"""Alert check on a stream that reads every event once.

Two queries. ``roll_up`` counts the events of each window as facts (``alerts.window_facts``) and appends them when the watermark has
passed it. ``watch`` reads the facts as a stream: a stateful operator per scope holds the windows of its baseline (sums, and
rows per value bucket of the duration), so a closed window is compared with what the state has, and enters it. Evidence comes from
the facts of the closed windows alone. Only where a P95 is over its threshold are values of the baseline looked
up: those of the one or two buckets that hold its rank, from the facts.

The state of a scope is bounded by the windows of a baseline times the value buckets that occur; a timer clears it when the
scope has been silent for a whole baseline.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.quantiles import opened_buckets, value_bucket
from ..plans import alerts
from ..session import cut, with_rocksdb
from .ingest import start

SUMS = ("events", "errors", "tokens", "retries")
CLOSED = T.StructType([
    T.StructField("base", T.StringType()), T.StructField("start", T.LongType()), *[T.StructField(f"b_{n}", T.LongType()) for n in SUMS], T.StructField("n", T.LongType()),
    T.StructField("low", T.LongType()), T.StructField("low_before", T.LongType()), T.StructField("high", T.LongType()), T.StructField("high_before", T.LongType()),
])


def seconds(spark: SparkSession, length: str) -> int:
    return int(spark.range(1).select(F.expr(f"CAST(INTERVAL {length} AS INTERVAL SECOND)").cast("decimal(20,6)").cast("bigint")).first()[0])


def merged(left: np.ndarray, right: np.ndarray, sign: int = 1) -> np.ndarray:
    """Two sorted tables (bucket, rows) as one; buckets without rows go."""
    buckets, place = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    rows = np.zeros(len(buckets), np.int64)
    np.add.at(rows, place, np.concatenate([left[1], sign * right[1]]))
    return np.stack([buckets[rows != 0], rows[rows != 0]])


class Baseline(StatefulProcessor):
    """Windows of one scope, in the order in which they close."""

    def __init__(self, every: int, reach: int, p: float = 0.95):
        self.every, self.reach, self.p = every, reach, p

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", "sums binary, buckets binary")
        self.total = handle.getValueState("total", "starts binary, sums binary, buckets binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = pd.concat(rows)
        starts, sums, buckets = self.read()
        out = []
        for at, window in facts.groupby("start"):
            at = int(at)
            for old in starts[starts < at - self.reach].tolist():
                gone = self.windows.getValue((old,))
                sums = sums - np.frombuffer(gone[0], np.int64)
                buckets = merged(buckets, np.frombuffer(gone[1], np.int64).reshape(2, -1), -1)
                self.windows.removeKey((old,))
            starts = starts[starts >= at - self.reach]
            out.append((key[0], at, *sums.tolist(), *self.rank(buckets)))
            whole = window[window["kind"] == "all"]
            mine = whole[list(SUMS)].to_numpy(np.int64).sum(axis=0)
            held = window[window["kind"] == "bucket"].sort_values("number")
            counts = np.stack([held["number"].to_numpy(np.int64), held["events"].to_numpy(np.int64)])
            self.windows.updateValue((at,), (mine.tobytes(), counts.tobytes()))
            starts, sums, buckets = np.append(starts, at), sums + mine, merged(buckets, counts)
        self.total.update((starts.astype(np.int64).tobytes(), sums.tobytes(), buckets.tobytes()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(1000 * (int(starts.max()) + self.reach + 2 * self.every))
        yield pd.DataFrame(out, columns=CLOSED.names).astype({n: "Int64" for n in CLOSED.names[1:]})

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.total.exists():
            return np.zeros(0, np.int64), np.zeros(len(SUMS), np.int64), np.zeros((2, 0), np.int64)
        starts, sums, buckets = (np.frombuffer(v, np.int64) for v in self.total.get())
        return starts, sums, buckets.reshape(2, -1)

    def rank(self, buckets: np.ndarray) -> tuple:
        """Rows in all, and the buckets that hold the ranks on either side of the percentile, with the rows below them."""
        upto = np.cumsum(buckets[1])
        if not len(upto):
            return 0, None, None, None, None
        place = (int(upto[-1]) - 1) * self.p
        found = [int(np.searchsorted(upto, edge, side="right")) for edge in (math.floor(place), math.ceil(place))]
        return int(upto[-1]), *(v for k in found for v in (int(buckets[0][k]), int(upto[k] - buckets[1][k])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for (old,) in list(self.windows.keys()):
            self.windows.removeKey((old,))
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def roll_up(
    stream: DataFrame, path: str, checkpoint: str, every: str = "15 minutes", by: Sequence[str] = (), delay: str = "5 minutes", ts: str = "ts", interval: str | None = None
) -> StreamingQuery:
    """Append the facts of every closed window to the table at ``path``."""
    watched = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    facts = alerts.window_facts(watched, every, by, ts)
    return start(facts.withColumn("day", F.to_date("window_start")), path, checkpoint, ("day",), interval)


def baselines(facts: DataFrame, every: int, reach: int) -> DataFrame:
    """What the state knows of the time before each window, when it closes; ``facts`` is a stream."""
    rows = facts.where(F.col("kind").isin("all", "bucket")).withWatermark("window_start", "0 seconds")
    columns = ["base", "window_start", "kind", "number", F.col("count").alias("events"), F.col("failures").alias("errors"), "tokens", "retries"]
    rows = rows.select(*columns, F.unix_timestamp("window_start").alias("start"))
    return rows.groupBy("base").transformWithStateInPandas(Baseline(every, reach), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")


def checked(facts: DataFrame, closed: DataFrame, reach: int, rules: alerts.Rules) -> DataFrame:
    """Wide rows of the closed windows: their facts beside their baselines, exact P95 of a baseline where the window's own is over the threshold."""
    closed = cut(closed.withColumn("window_start", F.timestamp_seconds("start")).withColumn("scope", alerts.window_scope()))  # one row per scope and window
    span = closed.agg(F.min("window_start").alias("low"), F.max("window_start").alias("high")).first()
    near = facts.where(F.col("day").between(span.low.date(), span.high.date())).join(closed.select("base", "window_start").distinct(), ["base", "window_start"], "left_semi")
    wide = cut(alerts.from_facts(near, closed.select("scope", *[f"b_{n}" for n in SUMS]), rules))
    slow = wide.where(F.col("p95_ms") >= F.col("t_ms")).select("scope").join(closed.where("n > 0"), "scope")
    ends = F.array_distinct(F.array(F.struct(F.col("low").alias("_b"), F.col("low_before").alias("_before")), F.struct(F.col("high").alias("_b"), F.col("high_before").alias("_before"))))
    asked = cut(slow.select("scope", "base", F.col("start").alias("_start"), F.col("n").alias("_n"), F.explode(ends).alias("e")).select("scope", "base", "_start", "_n", "e.*"))
    if asked.isEmpty():
        return wide
    since = F.lit(span.low.date()) - F.expr(f"INTERVAL {reach // 86400 + 1} DAY")
    values = facts.where((F.col("kind") == "duration") & F.col("day").between(since.cast("date"), F.lit(span.high.date())))
    values = values.select("base", F.unix_timestamp("window_start").alias("_at"), F.col("number").alias("_v"), F.col("count").alias("_rows"), value_bucket(F.col("number")).alias("_b"))
    opened = values.join(asked, ["base", "_b"]).where((F.col("_at") < F.col("_start")) & (F.col("_at") >= F.col("_start") - reach))
    opened = opened.groupBy("scope", "_b", "_v", "_before", "_n").agg(F.sum("_rows").alias("_c"))
    p95 = opened_buckets(opened, ["scope"], {"_p95": 0.95}).select("scope", (F.col("_p95") / F.lit(1e6)).alias("_p95"))
    return wide.join(p95, "scope", "left").withColumn("b_p95_ms", F.col("_p95")).drop("_p95")


def watch(
    spark: SparkSession, path: str, out: str, checkpoint: str, every: str = "15 minutes", baseline: str = "24 hours", rules: alerts.Rules = alerts.Rules(),
    interval: str | None = None, rows_out: str | None = None,
) -> StreamingQuery:
    """Write the alerts of each window that ``roll_up`` has closed below ``out``, and below ``rows_out`` their event rows.

    A repeated batch overwrites its own folders, so a retry adds nothing twice. The state needs RocksDB, whatever store the session has.
    """
    spark = with_rocksdb(spark)
    width, reach = seconds(spark, every), seconds(spark, baseline)
    stored = spark.read.parquet(path)

    def check(closed: DataFrame, batch: int) -> None:
        if closed.isEmpty():
            return
        wide = cut(checked(spark.read.schema(stored.schema).parquet(path), closed, reach, rules))
        found = alerts.analyze(wide)
        found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")
        if rows_out:
            alerts.alert_events(found, wide).write.mode("overwrite").parquet(f"{rows_out.rstrip('/')}/batch={batch}")

    closed = baselines(spark.readStream.schema(stored.schema).parquet(path), width, reach)
    writer = closed.writeStream.outputMode("append").foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
