"""Skew-proof helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def attach_by_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per key back to many rows; a NULL key matches a NULL key.

    A plain equi-join: where a key holds much of the rows, adaptive execution splits its
    partition and repeats the one matching row, as often as the data needs it.
    """
    keys = list(keys)
    named = {k: f"_key{n}" for n, k in enumerate(keys)}
    same = F.lit(True)
    for k, other in named.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    return rows.join(per_key.withColumnsRenamed(named), same, "inner").drop(*named.values())


def position_in_group(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
    of_key: dict[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """0-based position of each row within its key under ``order``; a NULL key is a key.

    Rows are dealt into sorted range partitions of key and order and numbered there. How
    many rows of a key lie in earlier partitions comes from a table of counts by key and
    partition, which has no more rows than keys and partitions together. No task sorts a
    whole key. The numbered rows are written, as partition borders are drawn anew by every
    evaluation. ``of_key`` names further values of a key, each as the aggregate of a partition
    and the one that combines partitions; they come with the same table.
    """
    keys, of_key = list(keys), of_key or {}
    parts = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = written(parts.withColumn("_id", F.monotonically_increasing_id()))
    # the upper bits are the partition, the others count its rows
    placed = numbered.withColumn("_part", F.shiftrightunsigned("_id", 33))
    counts = placed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"), *[part.alias(name) for name, (part, _) in of_key.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
        *[combine(name).over(Window.partitionBy(*keys)).alias(name) for name, (_, combine) in of_key.items()],
    )
    return (
        attach_by_key(placed, offsets, [*keys, "_part"])
        .withColumn(out, (F.col("_offset") + F.col("_id")).cast("bigint"))
        .drop("_id", "_part", "_offset")
    )


QUANTILE_BUCKETS = 256


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], out: str
) -> DataFrame:
    """Exact interpolated quantiles of each key as an array, without gathering a key.

    Equal values are counted first.  A mergeable sketch only proposes cut points
    that split each key into buckets of similar size; exact bucket counts then
    tell which buckets hold the wanted ranks, and only those are sorted.
    """
    keys = list(keys)
    counted = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    shares = F.array(*[F.lit(k / QUANTILE_BUCKETS) for k in range(1, QUANTILE_BUCKETS)])
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx("_value", shares, F.lit(10000)).alias("_cuts"), F.sum("_c").alias("_n")
    )
    placed = attach_by_key(counted, cuts, keys).select(
        *keys, "_value", "_c", "_n",
        F.expr("size(filter(_cuts, x -> x <= _value))").alias("_bucket"),
    )
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy(*keys, "_bucket", "_n").agg(F.sum("_c").alias("_held")).withColumn(
        "_start", F.coalesce(F.sum("_held").over(ahead), F.lit(0))
    )
    ranks = [(p * (F.col("_n") - 1)) for p in probabilities]
    wanted = [edge(r) for r in ranks for edge in (F.floor, F.ceil)]
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_held")))
    chosen = buckets.where(holds).select(*keys, "_bucket", "_start")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = attach_by_key(placed, chosen, [*keys, "_bucket"]).withColumn(
        "_first", F.col("_start") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    )
    at_rank = lambda rank: F.max(
        F.when((rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_c")), F.col("_value"))
    )
    parts = ranked.groupBy(*keys, "_n").agg(
        *[at_rank(F.floor(r)).alias(f"_lo{i}") for i, r in enumerate(ranks)],
        *[at_rank(F.ceil(r)).alias(f"_hi{i}") for i, r in enumerate(ranks)],
    )
    blended = [
        F.col(f"_lo{i}") + (r - F.floor(r)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
        for i, r in enumerate(ranks)
    ]
    return parts.select(*keys, F.array(*blended).alias(out))
