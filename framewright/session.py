"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch folder only for local sessions without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder. What is written there is removed when the driver ends."""
    path = f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(target.getParent())
    files.deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it from there.

    Later branches scan the table, only the columns they need, instead of computing it again; it outlives the
    executors that wrote it, and its size on disk lets the planner choose the joins.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
