"""A result store whose runs change in all tables together or not at all.

Tables are written under a new version first, which nobody reads. One small file in the
manifest then names the version of every run written: this is the commit. Readers take for
each geometry and run the version that the manifest named last, so a failure between two
tables leaves what was there before, and a run that is written again changes as a whole.

    root/<table>/version=<v>/geometry=<g>/run=<r>/*.parquet
    root/manifest/*.parquet      geometry, run, version, committed_ns, and the tables' schemas
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fits: a row for every fit; shots: products of every shot; arrays: the compact export
TABLES = ("fits", "shots", "profiles", "waveforms", "iv_grid", "runs", "arrays")
MANIFEST = "geometry string, run string, version string, committed_ns bigint, schemas string"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def is_versioned(spark: SparkSession, root: str) -> bool:
    files, path = _path(spark, f"{root}/manifest")
    return files.exists(path)


def _read(spark: SparkSession, path: str, schema: T.StructType, *partitions: str) -> DataFrame:
    """A partitioned table, perhaps without rows; runs named by digits keep their names."""
    text = [T.StructField(p, T.StringType()) for p in partitions]
    own = [f for f in schema.fields if f.name not in partitions]
    return spark.read.schema(T.StructType(own + text)).option("basePath", path).parquet(path)


class Staged:
    """One write of several tables: ``write`` each, then ``commit``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.schemas: dict[str, dict] = {}
        # names sort by time
        self.version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Writes rows with ``geometry`` and ``run`` and returns them as stored."""
        if table not in TABLES:
            raise ValueError(f"{table!r} is no table of the store.")
        path = f"{self.root}/{table}/version={self.version}"
        # without it every task has a file for every run; adaptive execution splits large runs again
        df.hint("rebalance", "geometry", "run").write.partitionBy("geometry", "run").parquet(path)
        self.schemas[table] = df.schema.jsonValue()
        return _read(self.spark, path, df.schema, "geometry", "run")

    def commit(self, runs: DataFrame) -> None:
        """Makes the version that of the (geometry, run) in ``runs``; one file, so it shows whole or not."""
        rows = runs.select("geometry", F.col("run").cast("string").alias("run")).distinct()
        named = rows.withColumns({"version": F.lit(self.version), "committed_ns": F.lit(time.time_ns()), "schemas": F.lit(json.dumps(self.schemas))})
        named.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")


def current(spark: SparkSession, root: str) -> DataFrame:
    """(geometry, run, version) in force; equal times go by version."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    return rows.groupBy("geometry", "run").agg(F.max_by("version", F.struct("committed_ns", "version")).alias("version"))


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows in force of a table, in its newest schema; all rows of a root that was written without versions."""
    if not is_versioned(spark, root):
        return spark.read.parquet(f"{root}/{table}")
    newest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").agg(F.max_by("schemas", F.struct("committed_ns", "version"))).first()[0]
    schema = T.StructType.fromJson(json.loads(newest)[table])
    rows = _read(spark, f"{root}/{table}", schema, "version", "geometry", "run")
    return rows.join(current(spark, root), ["geometry", "run", "version"], "left_semi").drop("version")


def remove_replaced(spark: SparkSession, root: str, older_than_s: float = 86_400) -> list[str]:
    """Deletes versions that no run uses, committed or not, and returns their names.

    Younger ones stay, as their write may still go on.
    """
    used = {r["version"] for r in current(spark, root).select("version").distinct().collect()}
    limit = f"{time.time_ns() - int(older_than_s * 1e9):020d}"
    gone = set()
    for table in TABLES:
        files, path = _path(spark, f"{root}/{table}")
        if not files.exists(path):
            continue
        for status in files.listStatus(path):
            name = status.getPath().getName()
            version = name.removeprefix("version=")
            if name != version and version not in used and version < limit:
                files.delete(status.getPath(), True)
                gone.add(version)
    return sorted(gone)
