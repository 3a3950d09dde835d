"""Floating potential, smoothed dI/dV and plasma potential of binned curves."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (
    DOUBLES, at, cut, diffs, half, index_range, last, let, let_struct, median, prefix_length, total,
)
from ..functions.text import Text, X, put
from ..params import MIN_CURVE_POINTS, FitParams
from .slope_batches import SLOPE, smooth_slope

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- T5 ------------------------------------------------------------------------------


def upward_zero(v: Text, i: Text, bound: Text | None = None) -> Text:
    """Zero of the highest adjacent pair that goes from I < 0 to I >= 0.

    With ``bound`` the lower node of the pair must lie below it.
    """

    def find(s: Text) -> Text:
        crossings = X.filter(
            index_range(0, X.size(s.v) - 1),
            lambda k: (at(s.i, k) < 0) & (at(s.i, k + 1) >= 0)
            & (X.lit(True) if bound is None else at(s.v, k) < s.bound),
        )
        return let(
            X.array_max(crossings),
            lambda k: let_struct(
                lambda t: t.v1 - t.i1 * (t.v2 - t.v1) / (t.i2 - t.i1),
                v1=at(s.v, k), v2=at(s.v, k + 1), i1=at(s.i, k), i2=at(s.i, k + 1),
            ),
        )

    limit = X.lit(None).cast("double") if bound is None else bound
    return let_struct(find, v=v, i=i, bound=limit)


def floating_potential(
    binned: DataFrame, out: str = "vf_V", bound: str | None = None, v: str = "vb", i: str = "ib"
) -> DataFrame:
    """T5: adds the floating potential of each curve."""
    limit = None if bound is None else X.col(bound)
    return put(binned, out, upward_zero(X.col(v), X.col(i), limit))


# --- T6 ------------------------------------------------------------------------------


def window_points(length: Text, step: Text, width: float) -> Text:
    """Odd window length in points: half-even rounding, at least three, within the curve."""
    points = X.greatest(X.lit(1), X.bround(X.lit(width) / step).cast("int"))
    odd = points + (1 - points % 2)
    return X.least(X.greatest(odd, X.lit(3)), length - (1 - length % 2))


def central_gradient(v: Text, y: Text) -> Text:
    """Second-order central difference for uneven spacing, one-sided at the ends."""

    def slope(s: Text, k: Text) -> Text:
        def interior(t: Text) -> Text:
            below, above = t.x - t.xm, t.xp - t.x
            return (
                below * below * t.yp + (above * above - below * below) * t.y
                - above * above * t.ym
            ) / (below * above * (below + above))

        return X.when(
            k == 0, (at(s.y, 1) - at(s.y, 0)) / (at(s.v, 1) - at(s.v, 0))
        ).when(
            k == X.size(s.v) - 1, (at(s.y, k) - at(s.y, k - 1)) / (at(s.v, k) - at(s.v, k - 1))
        ).otherwise(
            let_struct(
                interior, x=at(s.v, k), xm=at(s.v, k - 1), xp=at(s.v, k + 1),
                y=at(s.y, k), ym=at(s.y, k - 1), yp=at(s.y, k + 1),
            )
        )

    return let_struct(
        lambda s: X.transform(index_range(0, X.size(s.v)), lambda k: slope(s, k)), v=v, y=y
    )


def moving_mean(y: Text, window: Text) -> Text:
    """Centred mean over an odd window, over the samples that exist near the ends."""

    def smooth(s: Text) -> Text:
        def around(k: Text) -> Text:
            return let_struct(
                lambda t: total(cut(s.y, t.lo, t.hi - t.lo)) / (t.hi - t.lo),
                lo=X.greatest(X.lit(0), k - s.h), hi=X.least(X.size(s.y), k + s.h + 1),
            )

        return X.transform(index_range(0, X.size(s.y)), around)

    return let_struct(smooth, y=y, h=half(window))


def current_slope(
    curves: DataFrame, params: FitParams, v: str = "va", i: str = "ia", out: str = "didv"
) -> DataFrame:
    """Adds dI/dV by the configured smoothing and the edge length ``edge_points``.

    The slope is NULL when the curve is too short for the method.
    """
    smoothing, width, order = (
        params.vp_smoothing, params.vp_smoothing_width_V, params.vp_savgol_order,
    )
    enough = X.size(v) >= MIN_CURVE_POINTS

    def build(s: Text) -> Text:
        if smoothing == "none":
            return X.struct(
                central_gradient(s.v, s.i).alias("didv"), X.lit(1).alias("edge")
            )
        return let_struct(
            lambda t: X.struct(
                central_gradient(t.v, moving_mean(t.i, t.w)).alias("didv"),
                X.greatest(X.lit(1), half(t.w)).alias("edge"),
            ),
            v=s.v, i=s.i, w=window_points(X.size(s.v), s.step, width),
        )

    def slopes(voltages: pa.Array, currents: pa.Array) -> pa.Array:
        return smooth_slope(voltages, currents, width, order)

    if smoothing == "savgol":
        named = curves.withColumn("_slope", F.arrow_udf(slopes, SLOPE)(F.col(v).cast(DOUBLES), F.col(i).cast(DOUBLES)))
    else:
        built = X.when(
            enough,
            let_struct(build, v=X.col(v), i=X.col(i), step=median(diffs(X.col(v)))),
        )
        named = put(curves, "_slope", built)
    return put(named, 
        {out: X.col("_slope.didv"), "edge_points": X.col("_slope.edge")}
    ).drop("_slope")


# --- T7 ------------------------------------------------------------------------------


def derivative_peak(v: Text, didv: Text, edge: Text, vf: Text) -> Text:
    """Index of the interior dI/dV maximum above ``vf``, or NULL when it is not a knee."""

    def find(s: Text) -> Text:
        lo = X.greatest(s.edge + 1, prefix_length(s.v, lambda x: x <= s.vf))
        hi = X.size(s.v) - s.edge - 1
        return let_struct(choose, d=s.d, edge=s.edge, lo=lo, hi=hi)

    def choose(s: Text) -> Text:
        best = X.array_max(
            X.transform(
                index_range(s.lo, s.hi),
                lambda k: X.struct(at(s.d, k).alias("peak"), (-k).alias("neg")),
            )
        )
        return let(best, lambda b: check(s, -b.neg, b.peak))

    def check(s: Text, k: Text, peak: Text) -> Text:
        after = X.size(s.d) - s.edge - (k + s.edge)
        settled = median(cut(s.d, k + s.edge, after)) < 0.5 * peak
        good = (
            (s.hi - s.lo >= 3) & (k != s.lo) & (k != s.hi - 1) & (peak > 0)
            & (after >= 3) & settled
        )
        return X.when(good, k)

    return let_struct(find, v=v, d=didv, edge=edge, vf=vf)


def plasma_potential(curves: DataFrame, vf: str = "vf0_V", out: str = "vp_derivative_V") -> DataFrame:
    """Adds the knee voltage and its index ``vp_index`` on the analysis grid."""
    found = put(curves, 
        "vp_index",
        X.when(
            X.col(vf).is_set() & X.col("didv").is_set(),
            derivative_peak(X.col("va"), X.col("didv"), X.col("edge_points"), X.col(vf)),
        ),
    )
    return put(found, out, at(X.col("va"), X.col("vp_index")))


def on_display_grid(curves: DataFrame, out: str = "didv_grid") -> DataFrame:
    """T22 (second half): dI/dV interpolated from the even analysis grid to the display grid."""

    def resample(s: Text) -> Text:
        def value(x: Text) -> Text:
            k = X.greatest(
                X.lit(0), X.least(X.floor((x - s.v0) / s.step).cast("int"), X.size(s.d) - 2)
            )
            return let_struct(
                lambda t: t.d0 + (t.d1 - t.d0) * X.least(X.lit(1.0), t.f),
                d0=at(s.d, k), d1=at(s.d, k + 1), f=(x - s.v0) / s.step - k,
            )

        return X.transform(s.vg, value)

    grid = let_struct(
        resample, vg=X.col("vg"), d=X.col("didv"), v0=at(X.col("va"), 0),
        step=(last(X.col("va")) - at(X.col("va"), 0)) / (X.size("va") - 1),
    )
    return put(curves, out, X.when(X.col("didv").is_set(), grid))
