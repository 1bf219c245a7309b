"""Cutting lineage by reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder from ``spark.checkpoint.dir``; only a local session may do without, and uses one beside the warehouse."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def cut(df: DataFrame) -> DataFrame:
    ensure_folder(df.sparkSession)
    return df.checkpoint()
