"""Exponential on a linear background, nested windows and the hot-tail screen.

The model of a window is A exp(x/T) + C + D x with x = V - Vmax.  For a given T
the other three are linear, so only ln T is searched: a 49-point grid, then
narrowing around its best point, then Gauss-Newton steps on the residuals that
stay inside the bracket (:mod:`.window_fit`, batches of windows as arrays).
"""

from __future__ import annotations

import math
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import X, put
from ..params import BULK_WINDOW_WIDTHS_V, MIN_CURVE_POINTS, SIGNAL_TO_NOISE, FitParams
from .window_fit import CHECKS, FIT, SPANS, fitted, log_checks, nested_spans

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def fit_windows(windows: DataFrame, lower_eV: float, upper_eV: float) -> DataFrame:
    """Fits every window row (arrays ``wv, wi``) and adds struct ``bg``.

    ``bg`` has valid, te_eV, te_relative_uncertainty, amplitude_A, background_at_vmax_A,
    background_at_vmax_uncertainty_A, background_slope_A_per_V, rmse_A, r2, vstart_V, vstop_V
    and the component arrays fitted_A, exponential_A, background_A. A window needs seven
    increasing voltages without gaps and a varying current, else its ``bg`` is NULL.
    """
    if not (math.isfinite(lower_eV) and math.isfinite(upper_eV) and 0 < lower_eV < upper_eV):
        raise ValueError("temperature bounds must be finite, positive and ordered.")
    low, high = math.log(lower_eV), math.log(upper_eV)

    def fit(wv: pa.Array, wi: pa.Array) -> pa.Array:
        return fitted(wv, wi, low, high)

    doubles = [F.col(name).cast("array<double>") for name in ("wv", "wi")]
    return windows.withColumn("bg", F.arrow_udf(fit, FIT)(*doubles))


# --- T26 -----------------------------------------------------------------------------


def bulk_windows(
    stages: DataFrame, keys: list[str], params: FitParams,
    lower_eV: float | None = None, upper_eV: float | None = None,
) -> DataFrame:
    """Every nested window of every trace with its fit, checks and stability.

    Temperatures are searched between the parameters' bounds unless others are given.

    One row per (trace, width); ``stable`` marks windows that agree with the two
    narrower ones, ``is_bulk`` the widest stable window of the trace.  Without an ion
    estimate the checks fail; a trace without any window has one row with null width and fit.
    """
    lower_eV = params.te_min_eV if lower_eV is None else lower_eV
    upper_eV = params.te_max_eV if upper_eV is None else upper_eV
    # dealt by trace while a row holds its bins only: the windows and their fits then stay where they are
    traces = stages.select(
        *keys, "vb", "ib", (F.col("vp_derivative_V") - params.te_margin_from_vp).alias("_upper"), F.col("ion.noise").alias("noise_A")
    ).repartition(*keys)
    least = max(params.te_min_points, MIN_CURVE_POINTS)

    def spans(vb: pa.Array, upper: pa.Array) -> pa.Array:
        return nested_spans(vb, upper, BULK_WINDOW_WIDTHS_V, least)

    spread = traces.withColumn("_s", F.explode_outer(F.arrow_udf(spans, SPANS)("vb", "_upper")))
    start, n = (F.coalesce(f"_s.{name}", F.lit(0)) for name in ("start", "n"))
    windows = spread.select(
        *keys, "noise_A", F.col("_s.width").alias("width_V"), F.slice("vb", start + 1, n).alias("wv"), F.slice("ib", start + 1, n).alias("wi")
    )
    checked = window_checks(fit_windows(windows, lower_eV, upper_eV), params)
    w = Window.partitionBy(*keys).orderBy("width_V")
    good = F.col("bg.valid") & F.col("residual_pass") & F.col("bulk_log_pass")
    te = F.col("bg.te_eV")
    trio = [te, F.lag(te, 1).over(w), F.lag(te, 2).over(w)]
    flagged = checked.withColumn("_good", F.coalesce(good, F.lit(False)))
    agree = F.greatest(*trio) / F.least(*trio) < 1.05
    stable = (
        F.col("_good") & F.lag("_good", 1).over(w) & F.lag("_good", 2).over(w) & agree
    )
    marked = flagged.withColumn("stable", F.coalesce(stable, F.lit(False)))
    widest = F.max(F.when(F.col("stable"), F.col("width_V"))).over(Window.partitionBy(*keys))
    return marked.withColumn(
        "is_bulk", F.coalesce(F.col("stable") & (F.col("width_V") == widest), F.lit(False))
    ).drop("_good")


def window_checks(fits: DataFrame, params: FitParams) -> DataFrame:
    """Residual and block-log checks of a window fit; also the resolved signal range."""

    least, floor = params.te_min_points, params.te_current_floor_frac

    def checks(*columns: pa.Array) -> pa.Array:
        return log_checks(*columns, least, floor)

    judged = F.arrow_udf(checks, CHECKS)(
        "wv", "wi", "bg.exponential_A", "bg.background_A", "bg.amplitude_A", "bg.te_eV", "noise_A"
    )
    return put(
        fits.withColumn("_check", judged),
        {
            "residual_pass": X.coalesce(
                X.col("noise_A").is_set()
                & (
                    X.col("bg.rmse_A")
                    <= X.greatest(1.5 * X.col("noise_A"), 0.005 * X.col("bg.amplitude_A"))
                ),
                X.lit(False),
            ),
            "bulk_log_pass": X.col("_check.ok"),
            "bulk_signal_vstart_V": X.col("_check.v0"),
            "bulk_signal_vstop_V": X.col("_check.v1"),
        },
    ).drop("_check")


# --- T27 -----------------------------------------------------------------------------

# Texts of the screen's outcome.
R_INCONCLUSIVE = "A stable bulk/background decomposition was not resolved."
R_UNCALIBRATED = "Calibrated ion current and a resolved electron branch are required."
R_POSSIBLE = (
    "Significant excess electron background is consistent with a hot tail or beam; "
    "ion-current errors can also cause it."
)
R_NOT_RESOLVED = (
    "No significant excess electron background was resolved; a beam is not ruled out."
)


def hot_tail_screen(
    fits: DataFrame, bulk: DataFrame, keys: list[str], minimum_current_fraction: float
) -> DataFrame:
    """Status of every fit row given its bulk window (rows of ``bulk_windows``)."""
    if not (math.isfinite(minimum_current_fraction) and 0 < minimum_current_fraction <= 1):
        raise ValueError("minimum_current_fraction must be in (0, 1].")
    chosen = bulk.where("is_bulk").select(
        *keys, "width_V", "bg", "bulk_signal_vstart_V", "bulk_signal_vstop_V"
    )
    joined = fits.join(chosen, keys, "left")
    ready = (
        F.col("ion_current_A").isNotNull() & F.col("ion_current_uncertainty_A").isNotNull()
        & F.col("ion_noise_A").isNotNull() & F.coalesce(F.col("ies_A") > 0, F.lit(False))
    )
    found = ready & F.col("bg").isNotNull()
    excess = F.col("bg.background_at_vmax_A") - F.col("ion_current_A")
    error = F.hypot("bg.background_at_vmax_uncertainty_A", "ion_current_uncertainty_A")
    measured = joined.withColumns(
        {
            "excess_current_A": F.when(found, excess),
            "excess_current_uncertainty_A": F.when(found, error),
            "excess_current_fraction": F.when(found, excess / F.col("ies_A")),
        }
    )
    possible = F.coalesce(
        (F.col("excess_current_A") > SIGNAL_TO_NOISE * F.col("excess_current_uncertainty_A"))
        & (F.col("excess_current_fraction") >= minimum_current_fraction),
        F.lit(False),
    )
    return measured.withColumns(
        {
            "status": F.when(~found, "inconclusive").when(possible, "possible").otherwise("not_resolved"),
            "reason": F.when(~ready, R_UNCALIBRATED).when(~found, R_INCONCLUSIVE)
            .when(possible, R_POSSIBLE).otherwise(R_NOT_RESOLVED),
            "bulk_candidate_te_eV": F.when(found, F.col("bg.te_eV")),
            "background_vstart_V": F.when(found, F.col("bg.vstart_V")),
            "background_vstop_V": F.when(found, F.col("bg.vstop_V")),
        }
    ).drop("bg")
