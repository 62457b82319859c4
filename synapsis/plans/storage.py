"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local folder serves a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "synapsis-checkpoints")).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in reliable storage, for results that many later steps read."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df`` by way of the driver, for tables of names: Spark then knows how few rows there are."""
    return df.sparkSession.createDataFrame(df.toArrow())
