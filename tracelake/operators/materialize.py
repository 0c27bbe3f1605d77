"""Intermediate tables that several parts of a plan read: written once, in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[[^]]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
