"""Smoothing of field time series and two-component rotation.

A series may be very long, so it is never put in one task: rows are dealt into
chunks of consecutive samples, each chunk also receives the samples its filter
reaches beyond it, and windows run per (series, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights, polynomial_solution, polynomial_weights
from .keys import attach_by_key

CHUNK = 4096
BOUNDARIES = ("nearest", "reflect", "mirror", "constant", "wrap")


def series_lengths(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


# --- L1 ------------------------------------------------------------------------------


def fill_missing(
    series: DataFrame, keys: Sequence[str], value: str = "value", k: str = "k", chunk: int = CHUNK
) -> DataFrame:
    """L1: linear interpolation of missing samples in k, clamped at the ends.

    The nearest present samples outside a chunk come from one summary row per
    chunk.  A series without any value stays missing.
    """
    keys = list(keys)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(k).alias("k"), F.col(value).alias("v")))
    cut = series.withColumn("_chunk", F.floor(F.col(k) / chunk)).withColumn("_here", here)
    ends = cut.groupBy(*keys, "_chunk").agg(
        F.min("_here").alias("_low"), F.max("_here").alias("_high")
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    carried = ends.select(
        *keys, "_chunk",
        F.last("_high", True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_low", True).over(by_chunk.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(k)
    near = (
        cut.withColumns(
            {
                "_p": F.last("_here", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
                "_q": F.first("_here", True).over(inside.rowsBetween(1, Window.unboundedFollowing)),
            }
        )
        .join(carried, [*keys, "_chunk"])
        .withColumns({"_p": F.coalesce("_p", "_before"), "_q": F.coalesce("_q", "_after")})
    )
    p, q = F.col("_p"), F.col("_q")
    line = p["v"] + (F.col(k) - p["k"]) * (q["v"] - p["v"]) / (q["k"] - p["k"])
    filled = F.when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(line)
    return near.withColumn(value, F.coalesce(F.col(value), filled)).drop(
        "_chunk", "_here", "_p", "_q", "_before", "_after"
    )


# --- L2, L3, L4 ----------------------------------------------------------------------


def _extended(series: DataFrame, keys: list[str], value: str, k: str, before: int, after: int, mode: str) -> DataFrame:
    """Rows at positions -before .. n-1+after by the boundary rule; needs ``_n``."""
    n, i = F.col("_n"), F.col(k).cast("bigint")
    lo, hi = F.lit(-before).cast("bigint"), n - 1 + after
    if mode in ("nearest", "constant"):
        head = F.when(i == 0, F.sequence(lo, F.lit(-1).cast("bigint"))) if before else F.lit(None)
        tail = F.when(i == n - 1, F.sequence(n, hi)) if after else F.lit(None)
        none = F.array().cast("array<bigint>")
        copies = F.concat(
            F.coalesce(head.cast("array<bigint>"), none), F.coalesce(tail.cast("array<bigint>"), none)
        )
        everywhere = F.concat(F.array(i), copies)
    else:
        period = {"wrap": n, "reflect": 2 * n, "mirror": F.greatest(2 * n - 2, F.lit(1))}[mode]
        image = {"wrap": i, "reflect": -1 - i, "mirror": -i}[mode]
        turns = F.sequence(
            -F.ceil(F.lit(before) / period) - 1, F.ceil(F.lit(after) / period) + 1
        )
        reached = F.flatten(
            F.transform(turns, lambda m: F.array(i + period * m, image + period * m))
        )
        everywhere = F.array_distinct(F.filter(reached, lambda p: (p >= lo) & (p <= hi)))
    spread = series.withColumn("_pos", F.explode(everywhere))
    if mode == "constant":
        spread = spread.withColumn(
            value, F.when(F.col("_pos") == F.col(k), F.col(value)).otherwise(F.lit(0.0))
        )
    return spread


def _framed(series: DataFrame, keys: list[str], before: int, after: int, chunk: int) -> DataFrame:
    """Copies each row into every chunk whose window reaches it (column ``_chunk``)."""
    pos = F.col("_pos")
    return series.withColumn(
        "_chunk",
        F.explode(
            F.sequence(F.floor((pos - after) / chunk), F.floor((pos + before) / chunk))
        ),
    )


def _filtered(
    series: DataFrame, keys: Sequence[str], weights: list[float], before: int, after: int,
    mode: str, value: str, k: str, chunk: int, out: str,
) -> DataFrame:
    keys = list(keys)
    if mode not in BOUNDARIES:
        raise ValueError(f"unknown boundary {mode!r}; known are {', '.join(BOUNDARIES)}.")
    sized = attach_by_key(series, series_lengths(series, keys), keys)
    framed = _framed(_extended(sized, keys, value, k, before, after, mode), keys, before, after, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    if len(set(weights)) == 1:
        frame = w.rowsBetween(-before, after)
        # a frame with a missing sample, or cut by a chunk's end, has no mean
        smooth = F.when(F.count(value).over(frame) == len(weights), F.avg(value).over(frame))
    else:
        # a missing sample makes the whole sum missing
        smooth = sum(
            (F.lag(value, before - n).over(w) * float(x) for n, x in enumerate(weights)), F.lit(0.0)
        )
    own = (F.col("_pos") == F.col(k)) & (F.floor(F.col("_pos") / chunk) == F.col("_chunk"))
    return framed.withColumn(out, smooth).where(own).drop("_pos", "_chunk", "_n")


def moving_average(
    series: DataFrame, keys: Sequence[str], size: int, mode: str = "nearest",
    value: str = "value", k: str = "k", chunk: int = CHUNK, out: str = "smooth",
) -> DataFrame:
    """L2: mean of ``size`` samples; an even window reaches one sample further back."""
    if size < 1:
        raise ValueError("a window has at least one sample.")
    before = size // 2
    return _filtered(
        series, keys, [1.0 / size] * size, before, size - before - 1, mode, value, k, chunk, out
    )


def gaussian(
    series: DataFrame, keys: Sequence[str], sigma: float, mode: str = "nearest",
    value: str = "value", k: str = "k", chunk: int = CHUNK, out: str = "smooth",
) -> DataFrame:
    """L4: Gaussian weights out to four standard deviations."""
    if sigma <= 0:
        raise ValueError("the width of a Gaussian is above zero.")
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    return _filtered(series, keys, weights, reach, reach, mode, value, k, chunk, out)


def savgol(
    series: DataFrame, keys: Sequence[str], window: int, order: int,
    value: str = "value", k: str = "k", chunk: int = CHUNK, out: str = "smooth",
) -> DataFrame:
    """L3: local polynomial over an odd window; ends use the polynomial of the edge window.

    A series shorter than the window fails the query.
    """
    if window % 2 == 0:
        raise ValueError("a window with a middle sample is needed: give an odd size.")
    if window <= order:
        raise ValueError("the polynomial needs more samples than its order.")
    keys, half = list(keys), window // 2
    sized = attach_by_key(series, series_lengths(series, keys), keys)
    checked = sized.where(
        F.assert_true(F.col("_n") >= window, F.lit("a series is shorter than the window.")).isNull()
    ).withColumn("_pos", F.col(k).cast("bigint"))
    # the polynomials of the first and the last window of every series, from sums over their samples
    solve = polynomial_solution(window, order)
    sums = []
    for end, place in (("_first", F.col("_pos")), ("_last", F.col("_pos") - F.col("_n") + window)):
        inside = F.when(place.between(0, window - 1), F.col(value))
        sums.append(F.count(inside).alias(f"{end}_n"))
        for d, row in enumerate(solve):
            weights = F.array(*[F.lit(float(w)) for w in row])
            sums.append(F.sum(inside * F.get(weights, place.cast("int"))).alias(f"{end}{d}"))
    at_ends = checked.where((F.col("_pos") < window) | (F.col("_pos") >= F.col("_n") - window))
    fitted = attach_by_key(checked, at_ends.groupBy(*keys).agg(*sums), keys)
    framed = _framed(fitted, keys, half, half, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    # a missing sample makes the whole sum missing
    kernel = polynomial_weights(window, order, half)
    middle = sum((F.lag(value, half - n).over(w) * float(x) for n, x in enumerate(kernel)), F.lit(0.0))

    def curve(end: str, at) -> Column:
        """The end's polynomial at a distance from the middle of its window."""
        total = sum((F.col(f"{end}{d}") * F.pow(at, F.lit(d)) for d in range(order + 1)), F.lit(0.0))
        return F.when(F.col(f"{end}_n") == window, total)

    place = F.col("_pos").cast("double")
    smooth = F.when(F.col("_pos") < half, curve("_first", place - half)).when(
        F.col("_pos") >= F.col("_n") - half, curve("_last", place - F.col("_n") + window - half)
    ).otherwise(middle)
    drop = [f"{end}{d}" for end in ("_first", "_last") for d in ("_n", *range(order + 1))]
    own = F.floor(F.col("_pos") / chunk) == F.col("_chunk")
    return framed.withColumn(out, smooth).where(own).drop("_pos", "_chunk", "_n", *drop)


# --- L6 ------------------------------------------------------------------------------


def rotation_angles(
    series: DataFrame, keys: Sequence[str], by: str = "by", bz: str = "bz", remove_mean: bool = True
) -> DataFrame:
    """One row per series with the rotation angle and its diagnostics.

    Everything follows from one aggregation with map-side combine: the variances
    after rotation are those of the measured pair turned by the angle.
    """
    both = F.col(by).isNotNull() & F.col(bz).isNotNull()
    y, z = F.when(both, F.col(by)), F.when(both, F.col(bz))
    sums = series.groupBy(*keys).agg(
        F.count(y).alias("n"), F.avg(y).alias("_my"), F.avg(z).alias("_mz"),
        F.var_pop(y).alias("_vy"), F.var_pop(z).alias("_vz"), F.covar_pop(y, z).alias("_vyz"),
        F.var_pop(by).alias("var_by_measured"), F.var_pop(bz).alias("var_bz_measured"),
    ).where(F.assert_true(F.col("n") >= 3, F.lit("Not enough finite data points.")).isNull())
    shift = 0.0 if remove_mean else 1.0
    angled = sums.withColumns(
        {
            "cyy": F.col("_vy") + shift * F.col("_my") * F.col("_my"),
            "czz": F.col("_vz") + shift * F.col("_mz") * F.col("_mz"),
            "cyz": F.col("_vyz") + shift * F.col("_my") * F.col("_mz"),
        }
    ).withColumn("theta_rad", 0.5 * F.atan2(2.0 * F.col("cyz"), F.col("cyy") - F.col("czz")))
    c, s = F.cos("theta_rad"), F.sin("theta_rad")
    turned = lambda a, b, sign: (
        a * a * F.col("_vy") + 2.0 * sign * a * b * F.col("_vyz") + b * b * F.col("_vz")
    )
    return angled.withColumns(
        {
            "theta_deg": F.degrees("theta_rad"),
            "var_by_prime": turned(c, s, 1.0), "var_bz_prime": turned(s, c, -1.0),
        }
    ).withColumns(
        {
            "power_ratio_before": F.try_divide("var_by_measured", "var_bz_measured"),
            "power_ratio_after": F.try_divide("var_by_prime", "var_bz_prime"),
        }
    ).drop("_my", "_mz", "_vy", "_vz", "_vyz")


def rotate_pair(
    series: DataFrame, keys: Sequence[str], by: str = "by", bz: str = "bz", remove_mean: bool = True
) -> DataFrame:
    """Adds ``by_prime, bz_prime, theta_rad`` to every sample."""
    angles = rotation_angles(series, keys, by, bz, remove_mean).select(*keys, "theta_rad")
    c, s = F.cos("theta_rad"), F.sin("theta_rad")
    return attach_by_key(series, angles, keys).withColumns(
        {"by_prime": c * F.col(by) + s * F.col(bz), "bz_prime": c * F.col(bz) - s * F.col(by)}
    )
