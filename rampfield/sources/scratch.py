"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession, prefix: str = "rampfield") -> str:
    """A fresh path under ``spark.checkpoint.dir``, deleted when the session's process ends.

    Only in local mode is there a folder of its own where the setting is absent.
    """
    base = spark.conf.get(SETTING, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SETTING, base)
    name = f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # only paths that exist can be marked
    files.mkdirs(path)
    files.deleteOnExit(path)
    return name


def written(df: DataFrame) -> DataFrame:
    """The frame as a table on shared storage, so that later steps neither repeat it nor lose it."""
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
