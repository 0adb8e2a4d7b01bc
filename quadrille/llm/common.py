"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("executors share no local folder: name a shared one in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="quadrille-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; a lost executor costs nothing computed before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order."""
    return df.select(*[df[f"`{c}`"] for c in like.columns])
