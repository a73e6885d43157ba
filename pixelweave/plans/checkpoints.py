"""Lineage cuts in the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where it names none, one is set on a single machine, as in tests; on a cluster
    that is an error, as its machines share no local folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that lost executors lose no rows."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have the files of plans that a checkpoint has replaced removed now: Spark deletes shuffles that nothing refers to when
    the driver collects garbage, which many small steps would not make it do for long."""
    gc.collect()
    spark._jvm.System.gc()
