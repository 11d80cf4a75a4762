"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def own_folder(spark: SparkSession) -> None:
    """Names a folder of this machine where a local session has none, as in trial runs."""
    local = spark.sparkContext.master.startswith("local")
    if local and not spark.conf.get("spark.checkpoint.dir", None):
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, in this application's own part of it.

    What an application wrote can be removed as one folder once it has ended.
    """
    own = f"{shared_folder(spark).rstrip('/')}/shelfwise/{spark.sparkContext.applicationId}"
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame that several branches read and returns the written table.

    Cuts the lineage: a lost executor costs re-reading a file, not the whole chain.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
