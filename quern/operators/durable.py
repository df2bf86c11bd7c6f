"""Cuts of lineage that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of checkpoints, which driver and executors share: spark.checkpoint.dir. Where that is unset a temporary folder serves, on a local master alone."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df from a checkpoint: computed once, whatever is built on it."""
    shared(df.sparkSession)
    return df.checkpoint()
