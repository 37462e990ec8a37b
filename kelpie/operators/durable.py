"""Cuts of the lineage that survive the loss of executors, and the folder for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master (tests), else an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc._jsc.sc().getCheckpointDir().get()
    if not at:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="kelpie-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark)}/kelpie-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()
