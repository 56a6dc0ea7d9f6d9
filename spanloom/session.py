"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; cluster settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config(STATE_STORE, ROCKSDB)
        # rows of one session meet in their map task first, so a busy conversation is not one task's input
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """``spark``, or where its streams keep their state in Spark's default store a second session with the same settings whose
    streams keep it in RocksDB: ``transformWithState`` runs on no other store of Spark. ``spark`` itself stays as it is."""
    if not spark.conf.get(STATE_STORE).endswith(".HDFSBackedStateStoreProvider"):
        return spark
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(STATE_STORE, ROCKSDB)
    return own


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="run-", dir="/tmp" if os.path.isdir("/tmp") else None)
    context.setCheckpointDir(own)
    return context.getCheckpointDir() or own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(spark: SparkSession) -> int:
    """Partitions for a shuffle that must not be made smaller: the session's number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that later rounds do not replay it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, *partition: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, so that each reader takes the columns and partitions it needs."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A side of a join of at most this size is sent to every task.
BROADCAST_BYTES = 8 << 20


def small_side(df: DataFrame, limit: int | None = None, cheap: bool = False) -> DataFrame:
    """``df`` measured: marked for broadcast when its values take few enough bytes, left to
    a shuffled join when not. It is materialised first unless it is ``cheap`` to compute twice."""
    kept = df if cheap else cut(df)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in kept.columns), F.lit(0))
    size = kept.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(kept) if size <= (BROADCAST_BYTES if limit is None else limit) else kept


class Rounds:
    """Tables of an iteration in the shared folder; a round takes the place of the one before the last, which nobody reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.kept = spark, scratch_path(spark, label), []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self.kept)}"
        df.write.parquet(path)
        self.kept.append(path)
        if len(self.kept) > 2:
            self._remove(self.kept[-3])
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
