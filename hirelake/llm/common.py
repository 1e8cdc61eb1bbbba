"""Shared pieces: checkpoints in the cluster's shared folder, size-checked joins, Arrow batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (ids, a few numbers) may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a session in local mode names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="hirelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):  # whole texts: Spark's defaults make batches too large for small executors
        if not 0 < int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/hirelake/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder; lineage ends there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut, but written as Parquet: about half the bytes where rows are many and narrow."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a narrow, already checkpointed table for broadcast if its counted size allows it; else leaves it to a shuffle join."""
    return F.broadcast(df) if df.limit((rows or BROADCAST_ROWS) + 1).count() <= (rows or BROADCAST_ROWS) else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of each run of n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = mix64(h[: len(h) - n + 1])
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out
