"""Cutting the lineage of a DataFrame in the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset, one in /tmp on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder of the session."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(True)
