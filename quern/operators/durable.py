"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.operators.folders import shared_folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` kept in the folder of ``spark.checkpoint.dir``, which all executors share; a temporary one only where unset,
    on a single machine."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
