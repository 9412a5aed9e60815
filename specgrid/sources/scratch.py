"""The folder for intermediate tables, and tables written to it to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir).

    Where none is set and all run on one machine (local mode, as in tests), a temporary folder is set for the session.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over all of the session's shuffle partitions: adaptive execution merges none of them, so a task's windows stay as small as these are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the scratch folder and read back: its lineage ends here and a lost executor costs no work."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
