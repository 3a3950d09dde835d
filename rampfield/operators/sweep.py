"""From samples to a binned I-V curve and its grids.

Two grains are served.  When a trace is one row holding its samples, all steps
are projections.  When samples are rows of their own (or shots are pooled), the
bin means are a two-level aggregation with map-side combine, so a trace that
holds a large share of all samples is spread over many tasks before any of its
rows meet; only its bins, whose number is bounded by the swept voltage range
over the bin width, come together.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import DOUBLES, diffs, let, let_struct, total
from ..functions.text import Text, X, put
from ..params import MAX_REVERSE_SWEEP_FRACTION, MIN_CURVE_POINTS, FitParams
from .keys import attach_by_key, position_in_group
from .sweep_batches import BINS, GRIDS, bin_means, even_grids, one_way

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def clean(value: Text) -> Text:
    """DOUBLE with NaN and infinities turned into NULL."""
    number = value.cast("double")
    return X.when(~X.isnan(number) & (X.abs(number) <= 1.7976931348623157e308), number)


def clean_array(values: Text) -> Text:
    return X.transform(values.cast(DOUBLES), clean)


def pair_samples(v: Text, i: Text) -> Text:
    """Samples as array<struct<v,i>>, without those missing either value.

    Arrays of different length are an error.
    """
    same = X.assert_true(
        X.size(v) == X.size(i), X.lit("V and I must have the same length.")
    )
    pairs = X.zip_with(
        clean_array(v), clean_array(i), lambda a, b: X.struct(a.alias("v"), b.alias("i"))
    )
    return X.when(same.is_null(), X.filter(pairs, lambda p: p.v.is_set() & p.i.is_set()))


# --- T1 ------------------------------------------------------------------------------


def _travel_is_one_way(block_medians: Text, span: Text, width: float) -> Text:
    steps = diffs(block_medians)

    def judge(s: Text) -> Text:
        large = X.filter(
            s.steps,
            lambda d: X.abs(d) >= X.greatest(X.lit(width), 0.01 * s.span),
        )
        return let(
            large,
            lambda m: (X.size(m) > 0)
            & (
                X.least(
                    total(X.filter(m, lambda d: d > 0)), -total(X.filter(m, lambda d: d < 0))
                )
                <= MAX_REVERSE_SWEEP_FRACTION * s.span
            ),
        )

    return let_struct(judge, steps=steps, span=span)


def sweep_direction(traces: DataFrame, width: float, v: str = "v") -> DataFrame:
    """T1 on array rows: adds ``sweep_ok``, whether the voltage moves in one dominant direction."""

    def judge(values: pa.Array) -> pa.Array:
        return one_way(values, width)

    return traces.withColumn("sweep_ok", F.arrow_udf(judge, "boolean")(F.col(v).cast(DOUBLES)))


def sweep_direction_of_samples(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: float,
    v: str = "v",
) -> DataFrame:
    """T1 on sample rows: one row per trace with ``sweep_ok``.

    Positions come from counts of range partitions, so no task sorts a trace.
    """
    keys = list(keys)
    usable = samples.where(clean(X.col(v)).column().isNotNull()).withColumn("_v", clean(X.col(v)).column())
    narrow = usable.select(*keys, *[o for o in order if o not in keys], "_v")
    ranked = position_in_group(
        narrow, keys, order, "_k",
        {"_n": (F.count(F.lit(1)), F.sum), "_low": (F.min("_v"), F.min), "_high": (F.max("_v"), F.max)},
    )
    blocks = F.greatest(F.least(F.lit(25), F.floor(F.col("_n") / 3)), F.lit(1)).cast("bigint")
    whole, extra = F.floor(F.col("_n") / blocks), F.col("_n") % blocks
    long_part = extra * (whole + 1)
    block = F.when(F.col("_k") < long_part, F.floor(F.col("_k") / (whole + 1))).otherwise(
        extra + F.floor((F.col("_k") - long_part) / whole)
    )
    # percentile counts equal values before rows are shuffled
    medians = (
        ranked.groupBy(*keys, block.alias("_b"), "_n", (F.col("_high") - F.col("_low")).alias("_span"))
        .agg(F.percentile("_v", F.lit(0.5)).alias("_m"))
        .groupBy(*keys)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_b", "_m"))), lambda x: x["_m"]
            ).alias("_medians"),
            F.max("_n").alias("_n"), F.max("_span").alias("_span"),
        )
    )
    ok = (X.col("_n") >= MIN_CURVE_POINTS) & (X.col("_span") >= (MIN_CURVE_POINTS - 1) * width) & _travel_is_one_way(
        X.col("_medians"), X.col("_span"), width
    )
    return put(medians, "sweep_ok", X.coalesce(ok, X.lit(False))).select(*keys, "sweep_ok")


# --- T2 ------------------------------------------------------------------------------


def bin_traces(traces: DataFrame, width: float, v: str = "v", i: str = "i") -> DataFrame:
    """T2 on array rows: adds ``vb`` and ``ib`` (NULL with fewer than two bins)."""

    def bins(voltages: pa.Array, currents: pa.Array) -> pa.Array:
        return bin_means(voltages, currents, width)

    binned = traces.withColumn("_bins", F.arrow_udf(bins, BINS)(F.col(v).cast(DOUBLES), F.col(i).cast(DOUBLES)))
    return binned.withColumns({"vb": F.col("_bins.vb"), "ib": F.col("_bins.ib")}).drop("_bins")


def _unzip_bins(df: DataFrame) -> DataFrame:
    enough = X.size("_bins") >= 2
    return put(
        df,
        {
            "vb": X.when(enough, X.transform("_bins", lambda x: x.vb)),
            "ib": X.when(enough, X.transform("_bins", lambda x: x.ib)),
        },
    )


def bin_samples(
    samples: DataFrame, keys: Sequence[str], width: float, v: str = "v", i: str = "i"
) -> DataFrame:
    """T2 on sample rows: rows (keys, bin, vb, ib) with the bin number from the lowest voltage."""
    keys = list(keys)
    usable = samples.select(
        *keys, clean(X.col(v)).column().alias("_v"), clean(X.col(i)).column().alias("_i")
    ).where(
        "_v is not null and _i is not null"
    )
    lowest = usable.groupBy(*keys).agg(F.min("_v").alias("_v0"))
    return _bin_rows(attach_by_key(usable, lowest, keys), keys, width)


def _bin_rows(rows: DataFrame, keys: list[str], width: float) -> DataFrame:
    means = rows.groupBy(
        *keys, F.floor((F.col("_v") - F.col("_v0")) / width).alias("bin")
    ).agg(F.avg("_v").alias("vb"), F.avg("_i").alias("ib"))
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    return (
        means.withColumn("_before", F.lag("vb").over(by_bin))
        .where("_before is null or vb > _before")
        .drop("_before")
    )


def gather_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin rows to one row per trace with ``vb`` and ``ib``; traces with one bin drop out."""
    rows = bins.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("bin", "vb", "ib"))).alias("_bins")
    )
    return _unzip_bins(rows.where(F.size("_bins") >= 2)).drop("_bins")


# --- T3 ------------------------------------------------------------------------------


def pool_shots(
    traces: DataFrame, position_keys: Sequence[str], width: float, v: str = "v", i: str = "i"
) -> DataFrame:
    """Bin all shots of a position together; the bin means become the trace.

    Returns array rows (keys, v, i) ready for the ordinary analysis, which bins
    them a second time.  A position with fewer than two bins keeps empty arrays.
    """
    keys = list(position_keys)
    pairs = put(traces, "_p", pair_samples(X.col(v), X.col(i))).select(*keys, "_p")
    lowest = pairs.groupBy(*keys).agg(
        F.expr("min(array_min(_p.v))").alias("_v0")
    )
    rows = pairs.select(*keys, F.explode("_p").alias("_s")).select(
        *keys, F.col("_s.v").alias("_v"), F.col("_s.i").alias("_i")
    )
    bins = _bin_rows(attach_by_key(rows, lowest, keys), keys, width)
    pooled = gather_bins(bins, keys)
    none = F.array().cast(DOUBLES)
    return lowest.join(pooled, keys, "left").select(
        *keys,
        F.coalesce("vb", none).alias("v"),
        F.coalesce("ib", none).alias("i"),
    )


# --- T4 ------------------------------------------------------------------------------


def curve_grids(binned: DataFrame, params: FitParams) -> DataFrame:
    """T4: adds analysis grid ``va, ia`` and display grid ``vg, ig``.

    Curves with fewer than seven bins keep NULL grids.
    """
    points, width = params.iv_npts, params.voltage_bin_width

    def grids(voltages: pa.Array, currents: pa.Array) -> pa.Array:
        return even_grids(voltages, currents, points, width)

    out = binned.withColumn("_grids", F.arrow_udf(grids, GRIDS)(F.col("vb").cast(DOUBLES), F.col("ib").cast(DOUBLES)))
    return out.withColumns({n: F.col(f"_grids.{n}") for n in ("va", "ia", "vg", "ig")}).drop("_grids")
