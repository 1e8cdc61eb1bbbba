"""What jobs need from the session: the shared checkpoint folder, and its cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir; one of our own only where it is unset, in local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="hirelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/hirelake/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; lineage ends there, so a lost executor costs no recomputation. Spark removes the files when the
    frame is garbage, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cluster: what follows costs far more for each text than moving it, and files may be few or uneven."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
