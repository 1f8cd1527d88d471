"""Cutting lineage by reliable files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, or that the context was given; on a local master, where neither is set, one of our own."""
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "granary-checkpoints")
    if not given.isDefined():
        sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in files that outlive any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as they are now, written to ``path`` and read again. Unlike a checkpoint, which keeps the size that was estimated for its plan, these are as large as their files: where each round of a loop joins the last one's rows, estimates are multiplied until the number alone fills the driver's memory."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
