"""Session helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it was not installed or shipped (local runs)."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [*filter(None, (env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")))]
    if root not in os.pathsep.join(paths).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`). A machine-local one only in local runs that set none."""
    if where := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return where
    only_local(spark)
    return tempfile.mkdtemp(prefix="auditlake-")


def only_local(spark: SparkSession) -> None:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` held by files in the cluster's shared folder, so later steps don't repeat it and lost executors
    don't matter. Without a shared folder (local runs) it is kept by the session."""
    spark = df.sparkSession
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(where)
        return df.checkpoint()
    only_local(spark)
    return df.persist()
