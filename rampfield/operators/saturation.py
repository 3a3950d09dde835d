"""Ion and electron saturation branches of binned curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions.arrays import (
    MAD_TO_SIGMA, at, cut, diffs, dot, index_range, interpolate_at, last, let, let_struct,
    line_fit, mad_sigma, mean, median, prefix_length,
)
from ..functions.text import Text, X, put
from ..params import (
    ION_WINDOW_FRACTION, SATURATION_MAX_TREND, SATURATION_MIN_POINTS, SIGNAL_TO_NOISE, FitParams,
)

NO_REASON = X.lit(None).cast("string")

# Reasons recorded for a rejected branch.
ION_TOO_FEW = "too few independent points in the ion-saturation region"
ION_NOT_NEGATIVE = "ion-saturation current is not negative under the configured polarity"
ION_NOT_FLAT = "low-bias current does not form a constant ion-saturation plateau"
IES_VP_NOT_POSITIVE = "electron current at the plasma potential is not finite and positive"
IES_VP_NOT_RESOLVED = "electron current at the plasma potential is not resolved above ion noise"
IES_TOO_FEW = "too few independent points in the electron-saturation region"
IES_NOT_POSITIVE = "electron saturation current is not finite and positive"
IES_NOT_RESOLVED = "electron saturation current is not resolved above ion noise"
IES_NOT_FLAT = "high-bias current does not form an electron-saturation plateau"


def branch_statistics(v: Text, i: Text) -> Text:
    """struct(current, slope, intercept, noise, trend_span, residual) of one flat branch."""
    return let_struct(
        lambda s: let_struct(
            lambda t: X.struct(
                t.current.alias("current"),
                t.fit.slope.alias("slope"),
                t.fit.intercept.alias("intercept"),
                mad_sigma(t.fit.residual).alias("noise"),
                (X.abs(t.fit.slope) * t.span).alias("trend_span"),
                t.fit.residual.alias("residual"),
            ),
            current=median(s.i), fit=line_fit(s.v, s.i), span=last(s.v) - at(s.v, 0),
        ),
        v=v, i=i,
    )


# --- T9 ------------------------------------------------------------------------------


def effective_sample_count(values: Text) -> Text:
    """Independent samples from the leading positive autocorrelation, within [1, n].

    Lags are summed until the first that is not positive; later lags are not computed.
    """

    def count(s: Text) -> Text:
        n = X.size(s.c)
        start = X.struct(X.lit(0.0).alias("sum"), X.lit(False).alias("done"))

        def add(acc: Text, lag: Text) -> Text:
            return X.when(acc["done"], acc).otherwise(
                let(
                    dot(cut(s.c, 0, n - lag), cut(s.c, lag, n - lag)) / s.power,
                    lambda r: X.struct(
                        X.when(r > 0, acc["sum"] + r).otherwise(acc["sum"]).alias("sum"),
                        (r <= 0).alias("done"),
                    ),
                )
            )

        positive = X.aggregate(index_range(1, n), start, add, lambda acc: acc["sum"])
        spread = n / (1.0 + 2.0 * positive)
        return X.when(
            (n < 2) | (s.power <= 0), n.cast("double")
        ).otherwise(X.greatest(X.lit(1.0), X.least(spread, n.cast("double"))))

    return let_struct(
        lambda s: let(
            X.transform(s.a, lambda x: x - s.m),
            lambda c: let_struct(count, c=c, power=dot(c, c)),
        ),
        a=values, m=mean(values),
    )


# --- T8 ------------------------------------------------------------------------------


def ion_branch(binned: DataFrame, params: FitParams, vf: str = "vf_V") -> DataFrame:
    """Adds the ion-branch estimate as struct column ``ion``.

    ``ion.reason`` is NULL when the branch is usable; its numbers are then set.
    """

    def estimate(s: Text) -> Text:
        n = prefix_length(s.v, lambda x: x <= s.cutoff)
        return let(n, lambda m: X.when(m >= SATURATION_MIN_POINTS, measured(s, m)).otherwise(
            X.struct(X.lit(ION_TOO_FEW).alias("reason"), *_no_numbers(ION_FIELDS), X.lit(False).alias("trend_exceeds"), m.alias("n"))
        ))

    def measured(s: Text, m: Text) -> Text:
        return let_struct(
            lambda t: let_struct(
                judged,
                b=t.b, n=t.n, vmax=t.vmax,
                neff=effective_sample_count(t.b.residual),
            ),
            b=branch_statistics(cut(s.v, 0, m), cut(s.i, 0, m)),
            n=m, vmax=at(s.v, m - 1),
        )

    def judged(t: Text) -> Text:
        error = math.sqrt(math.pi / 2) * t.b.noise / X.sqrt(t.neff)
        trend = X.try_divide(t.b.trend_span, -t.b.current)
        too_steep = X.coalesce(trend > SATURATION_MAX_TREND, X.lit(False))
        reason = X.when(t.b.current.is_null() | (t.b.current >= 0), X.lit(ION_NOT_NEGATIVE))
        if params.enforce_ideal_model_checks:
            reason = reason.when(too_steep, X.lit(ION_NOT_FLAT))
        numbers = {
            "current": t.b.current, "noise": t.b.noise, "error": error,
            "snr": X.when(error > 0, -t.b.current / error).otherwise(X.lit(float("inf"))),
            "neff": t.neff, "slope": t.b.slope, "intercept": t.b.intercept,
            "trend_span": t.b.trend_span, "trend": trend, "vmax": t.vmax,
        }
        return let_struct(
            lambda u: X.struct(
                u.reason.alias("reason"),
                *[X.when(u.reason.is_null(), u[name]).alias(name) for name in ION_FIELDS],
                u.steep.alias("trend_exceeds"),
                u.n.alias("n"),
            ),
            reason=reason.otherwise(NO_REASON), steep=too_steep, n=t.n, **numbers,
        )

    built = let_struct(
        estimate, v=X.col("vb"), i=X.col("ib"),
        cutoff=at(X.col("vb"), 0)
        + ION_WINDOW_FRACTION * (X.col(vf) - at(X.col("vb"), 0)),
    )
    return put(binned, "ion", X.when(X.col(vf).is_set(), built))


ION_FIELDS = (
    "current", "noise", "error", "snr", "neff", "slope", "intercept", "trend_span", "trend", "vmax",
)


def _no_numbers(names: tuple[str, ...]) -> list[Text]:
    return [X.lit(None).cast("double").alias(name) for name in names]


# --- T10 -----------------------------------------------------------------------------


def derivative_significance(curves: DataFrame) -> DataFrame:
    """Adds ``peak_ok``, ``peak_didv``, ``peak_baseline`` and ``peak_noise``."""

    def judge(s: Text) -> Text:
        return let(
            cut(s.d, 0, prefix_length(s.v, lambda x: x <= s.vmax)),
            lambda low: let_struct(
                lambda t: X.struct(
                    t.base.alias("baseline"), t.noise.alias("noise"), t.peak.alias("peak"),
                    X.coalesce(
                        t.peak > t.base + SIGNAL_TO_NOISE * t.noise, X.lit(False)
                    ).alias("ok"),
                ),
                base=median(low), noise=mad_sigma(low), peak=at(s.d, s.k),
            ),
        )

    built = let_struct(
        judge, v=X.col("va"), d=X.col("didv"), k=X.col("vp_index"), vmax=X.col("ion.vmax")
    )
    return put(
        put(curves, "_peak", built),
        {
            "peak_ok": X.col("_peak.ok"), "peak_didv": X.col("_peak.peak"),
            "peak_baseline": X.col("_peak.baseline"), "peak_noise": X.col("_peak.noise"),
        },
    ).drop("_peak")


# --- T11 -----------------------------------------------------------------------------


def branch_support(binned: DataFrame, params: FitParams, vf: str = "vf_V") -> DataFrame:
    """Adds ``support_ok`` and ``support_gap_V``, the widest gap between bins above Vf."""

    def judge(s: Text) -> Text:
        n = X.size(s.v)
        below = prefix_length(s.v, lambda x: x < s.vf)
        return let_struct(
            lambda t: X.struct(
                t.gap.alias("gap"),
                X.coalesce(
                    t.gap <= X.greatest(5 * t.typical, X.lit(0.5 * params.vp_smoothing_width_V)),
                    X.lit(False),
                ).alias("ok"),
            ),
            gap=X.array_max(diffs(cut(s.v, below, n - below))), typical=median(diffs(s.v)),
        )

    built = let_struct(judge, v=X.col("vb"), vf=X.col(vf))
    return put(
        put(binned, "_gap", built),
        {"support_ok": X.col("_gap.ok"), "support_gap_V": X.col("_gap.gap")},
    ).drop("_gap")


# --- T12, T13, T14 -------------------------------------------------------------------

IES_FIELDS = ("current", "noise", "slope", "trend_span", "trend")


def _high_bias(v: Text, i: Text, vp: Text, ion_noise: Text, flat: bool) -> Text:
    def estimate(s: Text) -> Text:
        start = prefix_length(s.v, lambda x: x < s.cutoff)
        return let_struct(
            lambda t: X.when(
                t.n >= SATURATION_MIN_POINTS,
                let_struct(
                    judged, b=branch_statistics(cut(s.v, t.start, t.n), cut(s.i, t.start, t.n)),
                    noise=s.noise,
                ),
            ).otherwise(
                X.struct(
                    X.lit(IES_TOO_FEW).alias("reason"), *_no_numbers(IES_FIELDS),
                    X.lit(False).alias("trend_exceeds"),
                )
            ),
            start=start, n=X.size(s.v) - start,
        )

    def judged(t: Text) -> Text:
        trend = X.try_divide(t.b.trend_span, t.b.current)
        too_steep = X.coalesce(trend > SATURATION_MAX_TREND, X.lit(False))
        reason = X.when(t.b.current.is_null() | (t.b.current <= 0), X.lit(IES_NOT_POSITIVE)).when(
            t.b.current < SIGNAL_TO_NOISE * t.noise, X.lit(IES_NOT_RESOLVED)
        )
        if flat:
            reason = reason.when(too_steep, X.lit(IES_NOT_FLAT))
        values = {
            "current": t.b.current, "noise": t.b.noise, "slope": t.b.slope,
            "trend_span": t.b.trend_span, "trend": trend,
        }
        return let_struct(
            lambda u: X.struct(
                u.reason.alias("reason"),
                *[X.when(u.reason.is_null(), u[name]).alias(name) for name in IES_FIELDS],
                u.steep.alias("trend_exceeds"),
            ),
            reason=reason.otherwise(NO_REASON), steep=too_steep, **values,
        )

    return let_struct(
        lambda s: let_struct(
            estimate, v=s.v, i=s.i, noise=s.noise, cutoff=s.vp + 0.5 * (last(s.v) - s.vp)
        ),
        v=v, i=i, vp=vp, noise=ion_noise,
    )


def _at_vp(v: Text, i: Text, vp: Text, ion_current: Text, ion_noise: Text) -> Text:
    return let_struct(
        lambda s: let_struct(
            lambda t: X.struct(
                t.reason.alias("reason"),
                X.when(t.reason.is_null(), t.current).alias("current"),
                *_no_numbers(IES_FIELDS[1:]),
                X.lit(False).alias("trend_exceeds"),
            ),
            current=s.current,
            reason=X.when(s.current.is_null() | (s.current <= 0), X.lit(IES_VP_NOT_POSITIVE))
            .when(s.current < SIGNAL_TO_NOISE * s.noise, X.lit(IES_VP_NOT_RESOLVED))
            .otherwise(NO_REASON),
        ),
        current=interpolate_at(vp, v, i) - ion_current, noise=ion_noise,
    )


def electron_saturation(
    binned: DataFrame,
    params: FitParams,
    vp: str = "vp_derivative_V",
    method: str | None = None,
    out: str = "ies",
) -> DataFrame:
    """Adds the saturation-current estimate as a struct with ``reason``."""
    method = method or params.ies_method
    v, i, knee = X.col("vb"), X.col("ib"), X.col(vp)
    noise = X.col("ion.noise")
    if method == "at_vp":
        built = _at_vp(v, i, knee, X.col("ion.current"), noise)
    else:
        built = _high_bias(v, i, knee, noise, params.enforce_ideal_model_checks)
    return put(binned, out, X.when(noise.is_set() & knee.is_set(), built))


def plateau_disagreement(binned: DataFrame, vp: str = "vp_derivative_V") -> DataFrame:
    """Adds ``plateau_A`` (flat high-bias current or NULL) and ``plateau_disagrees``."""
    built = _high_bias(X.col("vb"), X.col("ib"), X.col(vp), X.col("ion.noise"), flat=True)
    flat = X.when(X.col("ion.noise").is_set() & X.col(vp).is_set(), built)
    out = put(binned, "plateau_A", flat["current"])
    return put(out, 
        "plateau_disagrees",
        X.coalesce(
            X.abs(X.col("ies.current") - X.col("plateau_A"))
            > SATURATION_MAX_TREND * X.col("plateau_A"),
            X.lit(False),
        ),
    )
