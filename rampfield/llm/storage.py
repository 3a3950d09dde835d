"""Tables in the folder that driver and executors share, and the packing of input rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir, deleted when the session's process ends."""
    return f"{scratch_folder(spark, 'llm')}/table"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """The frame written as a shared table and read back.

    This cuts lineage in a way that survives lost executors; the shuffle files of the
    write are removed when it ends, as nothing needs them any more.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): the whole input row as one struct, so that no added name can clash."""
    return docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"),
        named(id_col).alias("id"), named(text_col).alias("text"),
    )


def text_key() -> dict[str, Column]:
    """Two 64-bit hashes of the text: a null is told from an empty text by the constant."""
    text = F.coalesce(F.col("text"), F.lit("\x00null"))
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}
