"""Electron temperature from the retarding branch of binned curves."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (
    at, cut, dot, index_range, last, let, let_struct, line_fit, mean, split_start, total,
)
from ..functions.text import Text, X, put
from ..params import (
    SIGNAL_TO_NOISE, TE_CEILING_FRACTION, TE_CURVATURE_SIGMAS, TE_MAX_CURVATURE_LOG,
    TE_MAX_RELATIVE_SLOPE_ERROR, TE_MIN_LOG_SPAN, FitParams,
)
from .straight_search import FOUND, broadest_straight

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Reasons recorded for a rejected fit.
TE_TOO_FEW = "too few independent binned samples in the electron-retarding fit region"
TE_SLOPE = "electron-temperature slope is not finite and positive"
TE_RANGE = "electron temperature lies outside the configured physical range"
TE_R2 = "electron-temperature fit failed the R^2 threshold"
TE_SPAN = "electron-temperature fit spans less than one e-fold in current"
TE_UNCERTAIN = "electron-temperature slope uncertainty is too large"
TE_CURVED = "electron-retarding semilog branch has significant curvature"
TE_NOT_LINEAR = (
    "no sufficiently linear electron-retarding interval with resolved current "
    "and at least one e-fold of current span"
)

TE_NUMBERS = (
    "slope", "intercept", "r2", "rmse", "rel", "log_span", "curvature", "block_dev", "te",
    "vstart", "vstop",
)


# --- T15 -----------------------------------------------------------------------------


def eligible_intervals(binned: DataFrame, params: FitParams) -> DataFrame:
    """Adds ``te_intervals`` (uninterrupted eligible bins) and ``te_span``, the widest.

    Ties go to the interval with more bins, then to the earlier one.  Intervals
    are half-open index pairs into ``vb``.
    """

    def usable(s: Text, v: Text, i: Text) -> Text:
        ie = i - s.ion
        return (
            (v >= s.vf) & (v <= s.vp - params.te_margin_from_vp) & (ie > 0)
            & (ie >= s.floor) & (ie <= TE_CEILING_FRACTION * s.ies)
        )

    def islands(s: Text) -> Text:
        n = X.size(s.on)
        is_on = lambda k: X.coalesce(at(s.on, k), X.lit(False))
        starts = X.filter(index_range(0, n), lambda k: is_on(k) & ~is_on(k - 1))
        stops = X.filter(index_range(0, n), lambda k: is_on(k) & ~is_on(k + 1))
        return X.zip_with(
            starts, stops, lambda a, b: X.struct(a.alias("start"), (b + 1).alias("stop"))
        )

    flags = let_struct(
        lambda s: X.zip_with(s.v, s.i, lambda v, i: usable(s, v, i)),
        v=X.col("vb"), i=X.col("ib"), ion=X.col("ion.current"), ies=X.col("ies.current"),
        vf=X.col("vf_V"), vp=X.col("vp_derivative_V"),
        floor=X.greatest(
            params.te_current_floor_frac * X.col("ies.current"),
            SIGNAL_TO_NOISE * X.col("ion.noise"),
            X.lit(2.2250738585072014e-308),
        ),
    )
    found = put(binned, 
        "te_intervals",
        X.when(X.col("ies.current").is_set(), let_struct(islands, on=flags)),
    )
    widest = let_struct(
        lambda s: X.array_max(
            X.transform(
                s.all,
                lambda x: X.struct(
                    (at(s.v, x.stop - 1) - at(s.v, x.start)).alias("width"),
                    (x.stop - x.start).alias("n"),
                    (-x.start).alias("neg"),
                ),
            )
        ),
        all=X.col("te_intervals"), v=X.col("vb"),
    )
    return put(
        put(found, "_widest", widest),
        "te_span",
        X.when(
            X.col("_widest").is_set(),
            X.struct(
                (-X.col("_widest.neg")).alias("start"),
                (X.col("_widest.n") - X.col("_widest.neg")).alias("stop"),
            ),
        ),
    ).drop("_widest")


# --- T16 -----------------------------------------------------------------------------


def semilog_fit(v: Text, ie: Text, params: FitParams) -> Text:
    """Regress ln(ie) on v over whole arrays and apply the ordered acceptance checks.

    Returns struct(npts, <numbers>, curved, passed_r2, valid, reason).
    """

    def statistics(s: Text) -> Text:
        return let_struct(
            lambda t: let_struct(
                numbers, v=t.v, n=t.n, fit=t.fit, ss_res=dot(t.fit.residual, t.fit.residual),
                ss_tot=total(X.transform(t.y, lambda b: (b - t.fit.my) * (b - t.fit.my))),
                span=last(t.v) - at(t.v, 0), bend=quadratic(t),
                blocks=X.greatest(X.lit(1), X.least(X.lit(8), X.floor(t.n / 3).cast("int"))),
            ),
            v=s.v, y=s.y, n=X.size(s.v), fit=line_fit(s.v, s.y),
        )

    def quadratic(t: Text) -> Text:
        """struct(q, norm): coefficient on the centred second orthogonal polynomial.

        Positions are scaled by half the span, so q times four is the curvature
        over the whole window.
        """

        def solve(u: Text) -> Text:
            return let_struct(
                lambda w: X.struct(
                    X.try_divide(dot(w.p2, u.r), dot(w.p2, w.p2)).alias("q"),
                    dot(w.p2, w.p2).alias("norm"),
                ),
                p2=X.transform(u.t, lambda x: x * x - u.m2 - u.alpha * x),
            )

        scaled = let_struct(
            lambda u: X.transform(u.v, lambda x: (x - u.mx) / u.h),
            v=t.v, mx=t.fit.mx, h=(last(t.v) - at(t.v, 0)) / 2,
        )
        return let_struct(
            lambda u: let_struct(
                solve, t=u.t, r=u.r, m2=u.s2 / X.size(u.t), alpha=X.try_divide(u.s3, u.s2)
            ),
            t=scaled, r=t.fit.residual,
            s2=let(scaled, lambda a: dot(a, a)),
            s3=let(scaled, lambda a: total(X.transform(a, lambda x: x * x * x))),
        )

    def numbers(s: Text) -> Text:
        rising = s.fit.slope > 0
        r2 = X.when(s.ss_tot > 0, 1.0 - s.ss_res / s.ss_tot)
        rel = X.when(
            rising & (s.n > 2), X.sqrt(s.ss_res / (s.n - 2) / s.fit.sxx) / s.fit.slope
        )
        deviation = X.array_max(
            X.transform(
                index_range(0, s.blocks),
                lambda b: let_struct(
                    lambda t: X.abs(mean(cut(s.fit.residual, t.lo, t.hi - t.lo))),
                    lo=split_start(b, s.n, s.blocks), hi=split_start(b + 1, s.n, s.blocks),
                ),
            )
        )
        q_error = X.sqrt(
            X.greatest(X.lit(0.0), s.ss_res - s.bend.q * s.bend.q * s.bend.norm)
            / X.greatest(X.lit(1), s.n - 3) / s.bend.norm
        )
        curvature = X.when(s.n >= 5, 4.0 * X.abs(s.bend.q))
        return let_struct(
            judge, n=s.n, slope=s.fit.slope, intercept=s.fit.intercept, r2=r2,
            rmse=X.sqrt(s.ss_res / s.n), rel=rel, log_span=X.when(rising, s.fit.slope * s.span),
            curvature=curvature, block_dev=deviation, te=X.when(rising, 1.0 / s.fit.slope),
            vstart=at(s.v, 0), vstop=last(s.v),
            curved=X.coalesce(
                (curvature > TE_MAX_CURVATURE_LOG)
                & (X.abs(s.bend.q) > TE_CURVATURE_SIGMAS * q_error),
                X.lit(False),
            ),
            passed=X.coalesce(r2 >= params.te_min_r2, X.lit(False)),
        )

    def judge(s: Text) -> Text:
        bad = lambda good: ~X.coalesce(good, X.lit(False))
        reason = (
            X.when(bad(s.slope > 0), X.lit(TE_SLOPE))
            .when(bad(s.te.between(params.te_min_eV, params.te_max_eV)), X.lit(TE_RANGE))
            .when(~s.passed, X.lit(TE_R2))
            .when(bad(s.log_span >= TE_MIN_LOG_SPAN), X.lit(TE_SPAN))
            .when(bad(s.rel <= TE_MAX_RELATIVE_SLOPE_ERROR), X.lit(TE_UNCERTAIN))
        )
        if params.enforce_ideal_model_checks:
            reason = reason.when(s.curved, X.lit(TE_CURVED))
        return let(
            reason.otherwise(X.lit(None).cast("string")),
            lambda r: X.struct(
                s.n.alias("npts"), *[s[name].alias(name) for name in TE_NUMBERS],
                s.curved.alias("curved"), s.passed.alias("passed_r2"),
                r.is_null().alias("valid"), r.alias("reason"),
            ),
        )

    def too_few(n: Text) -> Text:
        return X.struct(
            n.alias("npts"), *[X.lit(None).cast("double").alias(name) for name in TE_NUMBERS],
            X.lit(False).alias("curved"), X.lit(False).alias("passed_r2"),
            X.lit(False).alias("valid"), X.lit(TE_TOO_FEW).alias("reason"),
        )

    return let_struct(
        lambda s: X.when(
            X.size(s.v) >= params.te_min_points,
            let_struct(statistics, v=s.v, y=X.transform(s.ie, lambda x: X.ln(x))),
        ).otherwise(too_few(X.size(s.v))),
        v=v, ie=ie,
    )


def _fit_over(binned: DataFrame, params: FitParams, span: str) -> Text:
    """Semilog fit over the bins of a span column; an empty span gives zero points."""
    start = X.coalesce(X.col(f"{span}.start"), X.lit(0))
    count = X.coalesce(X.col(f"{span}.stop") - X.col(f"{span}.start"), X.lit(0))
    return let_struct(
        lambda s: semilog_fit(
            cut(s.v, s.a, s.n), X.transform(cut(s.i, s.a, s.n), lambda x: x - s.ion), params
        ),
        v=X.col("vb"), i=X.col("ib"), a=start, n=count, ion=X.col("ion.current"),
    )


def bounded_fit(binned: DataFrame, params: FitParams, out: str = "te_fit") -> DataFrame:
    """T16 over the widest eligible interval; needs :func:`eligible_intervals`."""
    return put(binned, 
        out, X.when(X.col("te_intervals").is_set(), _fit_over(binned, params, "te_span"))
    )


# --- T17 -----------------------------------------------------------------------------

def linear_region(ready: DataFrame, params: FitParams, out: str = "te_fit") -> DataFrame:
    """Adds the fit over the broadest straight piece of the retarding branch.

    Needs :func:`eligible_intervals`.  Also adds ``te_fit_span`` and
    ``te_candidates``, the number of distinct intervals judged.

    Candidates are judged widest first, then by start and stop: those between even edges of
    every interval, and around the first straight one, if any, finer ones that are no narrower
    (:mod:`.straight_search`, batches of traces as arrays).
    """
    least_points, min_r2 = params.te_min_points, params.te_min_r2

    def search(*columns: pa.Array) -> pa.Array:
        return broadest_straight(*columns, least_points, min_r2)

    searched = ready.withColumn(
        "_best",
        F.arrow_udf(search, FOUND)(
            "vb", "ib", "te_intervals.start", "te_intervals.stop", "te_span.start", "te_span.stop", "ion.current"
        ),
    )
    spanned = put(searched, 
        {
            "te_fit_span": X.when(
                X.col("_best.start").is_set(),
                X.struct(X.col("_best.start").alias("start"), X.col("_best.stop").alias("stop")),
            ).otherwise(X.col("te_span")),
            "te_candidates": X.when(
                X.col("te_intervals").is_set(), X.col("_best.candidates")
            ),
        }
    )
    fitted = put(spanned, 
        "_fit",
        X.when(X.col("te_intervals").is_set(), _fit_over(spanned, params, "te_fit_span")),
    )
    return put(fitted, 
        out,
        X.when(X.col("_best.start").is_set() | X.col("_fit").is_null(), X.col("_fit")).otherwise(
            X.struct(
                X.col("_fit.npts").alias("npts"),
                *[X.col(f"_fit.{name}").alias(name) for name in TE_NUMBERS],
                X.col("_fit.curved").alias("curved"), X.col("_fit.passed_r2").alias("passed_r2"),
                X.lit(False).alias("valid"), X.lit(TE_NOT_LINEAR).alias("reason"),
            )
        ),
    ).drop("_best", "_fit")


def electron_temperature(binned: DataFrame, params: FitParams) -> DataFrame:
    """T15-T17 by the configured region method: ``te_fit``, ``te_fit_span``, ``te_candidates``."""
    ready = eligible_intervals(binned, params)
    if params.te_region_method == "linear_region":
        return linear_region(ready, params)
    return put(bounded_fit(ready, params), 
        {
            "te_fit_span": X.col("te_span"),
            "te_candidates": X.when(
                X.col("te_intervals").is_set(), X.col("te_span").is_set().cast("int")
            ),
        }
    )


# --- T18 -----------------------------------------------------------------------------


def fitted_plasma_potential(fits: DataFrame, params: FitParams) -> DataFrame:
    """Adds ``vp_fit_V``, ``vp_tolerance_V`` and ``vp_disagrees``."""
    slope = X.col("te_fit.slope")
    fitted = X.when(
        slope > 0, (X.ln(X.col("ies.current")) - X.col("te_fit.intercept")) / slope
    )
    tolerance = X.greatest(
        X.lit(2 * params.voltage_bin_width),
        X.least(X.lit(0.5 * params.vp_smoothing_width_V), 0.5 * X.col("te_fit.te")),
    )
    out = put(fits, {"vp_fit_V": fitted, "vp_tolerance_V": tolerance})
    agrees = (
        (X.col("vp_fit_V") > X.col("vf_V"))
        & (X.col("vp_fit_V") < last(X.col("vb")))
        & (X.abs(X.col("vp_fit_V") - X.col("vp_derivative_V")) <= X.col("vp_tolerance_V"))
    )
    return put(out, "vp_disagrees", ~X.coalesce(agrees, X.lit(False)))
