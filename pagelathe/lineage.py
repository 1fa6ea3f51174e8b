"""Cutting the plan of a table that several later steps read, so that none of them works it out again."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no spark.checkpoint.dir and all runs in one process, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints/pagelathe-lineage"


def cut(df: DataFrame) -> DataFrame:
    """df from files in spark.checkpoint.dir, which all executors share; they outlive a lost executor."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or OWN_FOLDER)
    return df.checkpoint(eager=True)
