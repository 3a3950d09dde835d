"""Density, leakage, the ordered quality gates and the per-trace result row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.arrays import at, let_struct
from ..functions.physics import electron_density_m3
from ..functions.text import Text, X, put
from ..params import MAX_LEAKAGE_FRACTION, FitParams
from .temperature import TE_CURVED

# Texts of warnings and notes.
W_DIRECTION = "voltage samples do not contain one dominant sweep direction"
W_CURVE = "could not construct a sufficiently sampled I-V curve"
W_ZERO = "absolute current zero is not independently calibrated"
W_CROSSING = "no bracketed negative-to-positive current crossing"
W_PEAK = "no interior plasma-potential derivative peak"
W_ORDER = "floating and plasma potentials are not physically ordered"
W_ION_SNR = "ion-saturation current estimate is not resolved above its uncertainty"
W_PEAK_NOISE = "plasma-potential derivative peak is not resolved above ion-region noise"
W_SUPPORT = "measured voltage bins do not continuously support the electron branch"
W_LEAKAGE = "negative-bias coverage is insufficient to isolate ion saturation"
W_AREA = "missing probe_area; electron density was not calculated"
N_ION_SLOPED = "ion-saturation branch is sloped; median region current was used"
N_IES_SLOPED = "electron-saturation branch is sloped; median region current was used"
N_LEAKAGE = "negative-bias coverage may include electron current in the ion estimate"
N_PLATEAU = (
    "electron current at derivative Vp disagrees with a nearly flat "
    "high-bias branch; inspect Vp smoothing and current-collection assumptions"
)
N_VP = "derivative and retarding/saturation plasma-potential estimates disagree"


def _bad(good: Text) -> Text:
    return ~X.coalesce(good, X.lit(False))


# --- T20 -----------------------------------------------------------------------------


def electron_leakage(fits: DataFrame) -> DataFrame:
    """Adds ``leakage``, electron current at the ion branch's end over the ion current."""
    return put(fits, 
        "leakage",
        X.exp(X.col("te_fit.slope") * X.col("ion.vmax") + X.col("te_fit.intercept"))
        / -X.col("ion.current"),
    )


# --- T21 -----------------------------------------------------------------------------


def early_gate(stages: DataFrame, params: FitParams) -> DataFrame:
    """First failing gate before the electron branch: adds ``gate`` and ``gate_reason``."""
    checks: list[tuple[int, Column, Text]] = [
        (1, _bad(X.col("sweep_ok")), X.lit(W_DIRECTION)),
        (2, X.col("va").is_null(), X.lit(W_CURVE)),
        (3, X.lit(not params.current_zero_calibrated), X.lit(W_ZERO)),
        (4, X.col("vf0_V").is_null(), X.lit(W_CROSSING)),
        (5, X.col("vp_derivative_V").is_null(), X.lit(W_PEAK)),
        (6, _bad(X.col("vf_V") < X.col("vp_derivative_V")), X.lit(W_ORDER)),
        (7, X.col("ion.reason").is_set(), X.col("ion.reason")),
        (8, _bad(X.col("ion.snr") >= params.ion_min_snr), X.lit(W_ION_SNR)),
        (9, _bad(X.col("peak_ok")), X.lit(W_PEAK_NOISE)),
        (10, _bad(X.col("support_ok")), X.lit(W_SUPPORT)),
    ]
    return _with_first(stages, checks, "gate", "gate_reason")


def _with_first(
    df: DataFrame, checks: list[tuple[int, Column, Text]], gate: str, reason: str
) -> DataFrame:
    first = X.when(
        checks[0][1], X.struct(X.lit(checks[0][0]).alias("g"), checks[0][2].alias("r"))
    )
    for number, failed, text in checks[1:]:
        first = first.when(failed, X.struct(X.lit(number).alias("g"), text.alias("r")))
    return (
        put(put(df, "_first", first), {gate: X.col("_first.g"), reason: X.col("_first.r")})
        .drop("_first")
    )


def final_gate(stages: DataFrame, params: FitParams) -> DataFrame:
    """Completes ``gate``/``gate_reason`` with the electron-branch gates."""
    ideal = X.lit(params.enforce_ideal_model_checks)
    at_vp = X.lit(params.ies_method == "at_vp")
    checks = [
        (11, X.col("ies.reason").is_set(), X.col("ies.reason")),
        (12, ideal & (X.col("leakage") > MAX_LEAKAGE_FRACTION), X.lit(W_LEAKAGE)),
        (13, ~X.col("te_fit.valid"), X.col("te_fit.reason")),
        (14, ideal & at_vp & X.col("plateau_disagrees"), X.lit(N_PLATEAU)),
        (15, ideal & X.col("vp_disagrees"), X.lit(N_VP)),
    ]
    late = _with_first(stages, checks, "_late_gate", "_late_reason")
    return put(late, 
        {
            "gate": X.coalesce("gate", "_late_gate"),
            "gate_reason": X.coalesce("gate_reason", "_late_reason"),
        }
    ).drop("_late_gate", "_late_reason")


FIT_SCALARS = (
    "ok", "gate", "warnings", "model_notes", "te_eV", "vp_V", "vp_fit_V", "vp_derivative_V",
    "vf_V", "ies_A", "ies_method", "te_region_method", "iis_A", "n_e_m3", "ion_current_A",
    "ion_noise_A", "ion_current_uncertainty_A", "ion_current_snr", "ion_effective_sample_count",
    "ion_fit_slope_A_per_V", "electron_saturation_slope_A_per_V",
    "ion_saturation_trend_fraction", "electron_saturation_trend_fraction",
    "electron_leakage_fraction", "te_fit_r2", "te_fit_rmse", "te_fit_npts", "te_fit_vstart",
    "te_fit_vstop", "te_fit_slope", "te_fit_intercept", "te_fit_relative_uncertainty",
    "te_fit_log_span", "te_fit_curvature_log", "te_fit_curvature_flagged", "te_fit_valid",
    "te_fit_i0", "te_fit_passed_r2", "te_fit_candidate_count",
)


def result_row(stages: DataFrame, params: FitParams, keep: list[str]) -> DataFrame:
    """The flat result of every trace; estimates set before a failing gate are kept."""
    gate = X.coalesce(X.col("gate"), X.lit(99))
    since = lambda number, value: X.when(gate > number, value)
    note = lambda when, text: X.when(X.coalesce(when, X.lit(False)), X.lit(text))
    ideal = params.enforce_ideal_model_checks
    te = lambda name: since(11, X.col(f"te_fit.{name}"))
    flag = lambda name: X.coalesce(te(name), X.lit(False))
    ok = gate == 99
    vp = X.when(ok & ~X.col("vp_disagrees"), X.col("vp_fit_V")).otherwise(X.col("vp_derivative_V"))
    notes = [
        note((gate > 8) & X.col("ion.trend_exceeds"), N_ION_SLOPED),
        note((gate > 11) & X.col("ies.trend_exceeds"), N_IES_SLOPED),
        note((gate > 11) & X.col("te_fit.curved"), TE_CURVED),
        note((gate > 11) & (X.col("leakage") > MAX_LEAKAGE_FRACTION) & X.lit(not ideal), N_LEAKAGE),
        note(
            (gate > 13) & X.col("plateau_disagrees") & X.lit(params.ies_method == "at_vp" and not ideal),
            N_PLATEAU,
        ),
        note((gate > 13) & X.col("vp_disagrees") & X.lit(not ideal), N_VP),
    ]
    area_warning = X.lit(W_AREA if params.probe_area is None else None).cast("string")
    density = (
        X.lit(None).cast("double") if params.probe_area is None
        else electron_density_m3(X.col("ies.current"), X.col("te_fit.te"), params.probe_area)
    )
    columns = {
        "ok": ok,
        "gate": X.col("gate"),
        "warnings": X.array_compact(
            X.array(X.col("gate_reason"), X.when(ok, area_warning))
        ),
        "model_notes": X.array_compact(X.array(*notes)),
        "te_eV": te("te"),
        "vp_V": since(6, vp),
        "vp_fit_V": since(11, X.col("vp_fit_V")),
        "vp_derivative_V": since(6, X.col("vp_derivative_V")),
        "vf_V": since(6, X.col("vf_V")),
        "ies_A": since(11, X.col("ies.current")),
        "ies_method": X.lit(params.ies_method),
        "te_region_method": X.lit(params.te_region_method),
        "iis_A": since(7, -X.col("ion.current")),
        "n_e_m3": since(11, density),
        "ion_current_A": since(7, X.col("ion.current")),
        "ion_noise_A": since(7, X.col("ion.noise")),
        "ion_current_uncertainty_A": since(7, X.col("ion.error")),
        "ion_current_snr": since(7, X.col("ion.snr")),
        "ion_effective_sample_count": since(7, X.col("ion.neff")),
        "ion_fit_slope_A_per_V": since(7, X.col("ion.slope")),
        "electron_saturation_slope_A_per_V": since(11, X.col("ies.slope")),
        "ion_saturation_trend_fraction": since(7, X.col("ion.trend")),
        "electron_saturation_trend_fraction": since(11, X.col("ies.trend")),
        "electron_leakage_fraction": since(11, X.col("leakage")),
        "te_fit_r2": te("r2"),
        "te_fit_rmse": te("rmse"),
        "te_fit_npts": X.coalesce(te("npts"), X.lit(0)),
        "te_fit_vstart": te("vstart"),
        "te_fit_vstop": te("vstop"),
        "te_fit_slope": te("slope"),
        "te_fit_intercept": te("intercept"),
        "te_fit_relative_uncertainty": te("rel"),
        "te_fit_log_span": te("log_span"),
        "te_fit_curvature_log": te("curvature"),
        "te_fit_curvature_flagged": flag("curved"),
        "te_fit_valid": flag("valid"),
        "te_fit_i0": since(7, X.col("ion.current")),
        "te_fit_passed_r2": flag("passed_r2"),
        "te_fit_candidate_count": X.coalesce(since(11, X.col("te_candidates")), X.lit(0)),
    }
    return stages.select(*keep, *[c.column().alias(name) for name, c in columns.items()])


# --- T22, T23 ------------------------------------------------------------------------


def display_fit_mask(stages: DataFrame) -> DataFrame:
    """Adds ``fit_mask`` on the display grid, true between the fit's end voltages."""
    inside = let_struct(
        lambda s: X.transform(
            s.vg, lambda x: X.coalesce((x >= s.lo) & (x <= s.hi), X.lit(False))
        ),
        vg=X.col("vg"), lo=at(X.col("vb"), X.col("te_fit_span.start")),
        hi=at(X.col("vb"), X.col("te_fit_span.stop") - 1),
    )
    return put(stages, "fit_mask", inside)


def fitted_bins(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Bin rows (keys, bin, vb, ib, in_fit) with the exact bins of the fit flagged."""
    rows = stages.selectExpr(*keys, "te_fit_span", "posexplode(arrays_zip(vb, ib)) as (bin, _b)")
    return rows.selectExpr(
        *keys, "bin", "_b.vb as vb", "_b.ib as ib",
        "coalesce(bin >= te_fit_span.start and bin < te_fit_span.stop, false) as in_fit",
    )


# --- T24 -----------------------------------------------------------------------------


def _digits(value: Text, digits: int) -> Text:
    """A number with ``digits`` significant digits in general format.

    Scientific notation is used below 1e-4 and from 10^digits on; trailing zeros go.
    """
    scientific = X.format_string(X.lit(f"%.{digits - 1}e"), value)
    mantissa = X.regexp_extract(scientific, X.lit("^(.*)e"), 1)
    exponent = X.regexp_extract(scientific, X.lit("e([+-][0-9]+)$"), 1)
    power = exponent.cast("int")

    def strip(text: Text) -> Text:
        return X.when(
            X.contains(text, X.lit(".")), X.regexp_replace(text, X.lit("[.]?0+$"), X.lit(""))
        ).otherwise(text)

    fixed = X.when(power == -4, X.format_string(X.lit(f"%.{digits + 3}f"), value))
    for p in range(-3, digits):
        fixed = fixed.when(power == p, X.format_string(X.lit(f"%.{digits - 1 - p}f"), value))
    return (
        X.when(value == 0, X.lit("0"))
        .when(power.between(-4, digits - 1), strip(fixed))
        .otherwise(X.concat(strip(mantissa), X.lit("e"), exponent))
    )


def summary_lines(fits: DataFrame) -> DataFrame:
    """Adds ``summary``, the text lines describing each trace."""

    def number(label: str, name: str, unit: str, digits: int, missing: bool = True) -> Text:
        column = X.col(name)
        parts = [X.lit(f"{label} = "), _digits(column, digits)]
        if unit:
            parts.append(X.lit(f" {unit}"))
        shown = X.when(column.is_set(), X.concat(*parts))
        return shown.otherwise(X.lit(f"{label} = NaN")) if missing else shown

    def name_of(label: str, column: str) -> Text:
        return X.when(X.col(column).is_set(), X.concat(X.lit(f"{label} = "), X.col(column)))

    lines = [
        number("Te", "te_eV", "eV", 4),
        number("Vp", "vp_V", "V", 4),
        number("Vf", "vf_V", "V", 4),
        number("I_es", "ies_A", "A", 3),
        number("I_is", "iis_A", "A", 3),
        number("n_e", "n_e_m3", "m^-3", 3),
        name_of("I_es method", "ies_method"),
        name_of("Te region", "te_region_method"),
        X.concat(
            X.lit("fit valid = "),
            X.when(X.col("te_fit_valid"), X.lit("yes")).otherwise(X.lit("no")),
        ),
        X.when(
            X.col("te_fit_r2").is_set(), X.format_string(X.lit("R^2 = %.4f"), "te_fit_r2")
        ).otherwise(X.lit("R^2 = NaN")),
        number("slope rel. uncertainty", "te_fit_relative_uncertainty", "", 3),
        X.format_string(X.lit("independent N = %d"), "te_fit_npts"),
        X.when(
            X.col("te_fit_vstart").is_set() & X.col("te_fit_vstop").is_set(),
            X.concat(
                X.lit("V fit = "), _digits(X.col("te_fit_vstart"), 3), X.lit(" to "),
                _digits(X.col("te_fit_vstop"), 3), X.lit(" V"),
            ),
        ),
        number("Vp derivative seed", "vp_derivative_V", "V", 4, missing=False),
        number("Vp fit extrapolation", "vp_fit_V", "V", 4, missing=False),
        number("I_ion", "ion_current_A", "A", 3, missing=False),
        number("ion residual MAD sigma", "ion_noise_A", "A", 3, missing=False),
        number("I_ion uncertainty", "ion_current_uncertainty_A", "A", 3, missing=False),
        number("I_ion estimate SNR", "ion_current_snr", "", 3, missing=False),
        X.when(
            X.size("model_notes") > 0,
            X.format_string(X.lit("ideal-model deviations = %d"), X.size("model_notes")),
        ),
    ]
    return put(fits, "summary", X.array_compact(X.array(*lines)))
