"""Folders and tables that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one on local masters only, where there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pointmill-")
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_scratch(spark: SparkSession) -> None:
    """Delete the folders that this process's operators wrote so far; what was read from them and not computed yet is lost."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new shared folder and read again: they are computed once, and a lost executor costs one re-read."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
