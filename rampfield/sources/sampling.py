"""Sampling interval and trace length of the channels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import attach_by_key
from ..params import TIMING_SOURCES

# Relative and absolute tolerance between two sample intervals.
INTERVAL_RTOL = 1e-9
INTERVAL_ATOL = 1e-15
FLOAT_EPS = {"float": 2.0**-23, "double": 2.0**-52}


def intervals_from_clock(specs: DataFrame) -> DataFrame:
    """SRC7, clock form: adds ``dt_s`` = sample average / clock rate (NULL when invalid)."""
    average = F.coalesce(F.col("sample_average"), F.lit(1.0)).cast("double")
    dt = F.when(F.col("clock_rate_hz") > 0, average / F.col("clock_rate_hz"))
    return specs.withColumn("dt_s", F.when(dt > 0, dt)).withColumn(
        "nt_ok", F.coalesce(F.col("nt") >= 2, F.lit(False))
    )


def intervals_from_axis(
    time_axis: DataFrame, keys: list[str], stored_type: str = "double"
) -> DataFrame:
    """SRC7, stored-axis form: one row per channel with ``dt_s``, ``linear`` and ``nt``.

    The interval is the mean step; the axis is linear when every time lies within
    8 eps of the scale from the line through its ends.  Both passes aggregate with
    map-side combine.
    """
    ends = time_axis.groupBy(*keys).agg(
        F.min_by("t_s", "k").alias("_t0"), F.max_by("t_s", "k").alias("_t1"),
        F.count(F.lit(1)).alias("nt"), F.count("t_s").alias("_finite"),
        F.max(F.abs("t_s")).alias("_top"), F.min("k").alias("_k0"),
    )
    stepped = ends.withColumn("dt_s", F.try_divide(F.col("_t1") - F.col("_t0"), F.col("nt") - 1))
    off = F.abs(F.col("t_s") - (F.col("_t0") + (F.col("k") - F.col("_k0")) * F.col("dt_s")))
    worst = attach_by_key(time_axis, stepped, keys).groupBy(*keys).agg(F.max(off).alias("_off"))
    scale = F.greatest(F.col("_top"), F.abs("dt_s"))
    return stepped.join(worst, keys).select(
        *keys, "nt", "dt_s",
        F.coalesce(
            (F.col("_finite") == F.col("nt")) & (F.col("dt_s") > 0)
            & (F.col("_off") <= 8 * FLOAT_EPS[stored_type] * scale),
            F.lit(False),
        ).alias("linear"),
    )


def close_intervals(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(
        INTERVAL_RTOL * F.greatest(F.abs(a), F.abs(b)), F.lit(INTERVAL_ATOL)
    )


def channel_agreement(
    channels: DataFrame, keys: list[str], voltage_channel: int, current_channel: int
) -> DataFrame:
    """SRC7: compares voltage and current channel; one row per key with the violation."""
    pick = lambda c, name: F.max(F.when(F.col("channel") == c, F.col(name)))
    entries = lambda c: F.count_if(F.col("channel") == c)
    pair = channels.groupBy(*keys).agg(
        F.greatest(entries(voltage_channel), entries(current_channel)).alias("_entries"),
        pick(voltage_channel, "nt").alias("v_nt"), pick(current_channel, "nt").alias("i_nt"),
        pick(voltage_channel, "dt_s").alias("v_dt_s"), pick(current_channel, "dt_s").alias("i_dt_s"),
    )
    return pair.withColumn(
        "violation",
        F.when(F.col("_entries") > 1, F.lit("several entries of a channel"))
        .when(F.col("v_nt").isNull() | F.col("i_nt").isNull(), F.lit("missing trace length"))
        .when(F.col("v_dt_s").isNull() | F.col("i_dt_s").isNull(), F.lit("missing sample interval"))
        .when(F.least("v_nt", "i_nt") < 2, F.lit("fewer than two samples"))
        .when(F.col("v_nt") != F.col("i_nt"), F.lit("different trace lengths"))
        .when(~close_intervals(F.col("v_dt_s"), F.col("i_dt_s")), F.lit("different sample intervals")),
    ).drop("_entries")


def resolve_interval(
    agreement: DataFrame, configured_dt_s: float, source: str
) -> DataFrame:
    """SRC7: the interval to use, ``dt_s``; stored metadata must match when it is the source."""
    if not math.isfinite(configured_dt_s) or configured_dt_s <= 0:
        raise ValueError("Configured sample interval must be positive and finite.")
    if source not in TIMING_SOURCES:
        raise ValueError(f"Unsupported temporal information source {source!r}.")
    fixed = F.lit(float(configured_dt_s))
    conflict = F.lit(None).cast("string")
    differs = F.when(
        ~close_intervals(F.col("v_dt_s"), F.col("i_dt_s")), F.lit("different sample intervals")
    )
    if source == "hdf5":
        conflict = F.when(
            ~close_intervals(fixed, F.col("v_dt_s")), F.lit("voltage interval changed")
        ).when(~close_intervals(fixed, F.col("i_dt_s")), F.lit("current interval changed"))
    return agreement.withColumn("violation", F.coalesce("violation", differs, conflict)).withColumn(
        "dt_s", F.when(F.col("violation").isNull(), fixed)
    )
