"""Analysis of every trace of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.potentials import (
    current_slope, floating_potential, on_display_grid, plasma_potential,
)
from ..operators.quality import (
    display_fit_mask, early_gate, electron_leakage, final_gate, result_row,
)
from ..operators.saturation import (
    branch_support, derivative_significance, electron_saturation, ion_branch,
    plateau_disagreement,
)
from ..operators.sweep import bin_traces, curve_grids, sweep_direction
from ..operators.temperature import electron_temperature, fitted_plasma_potential
from ..params import FitParams
from ..sources.scratch import written


def curves(traces: DataFrame, params: FitParams) -> DataFrame:
    """Direction check, bins and grids; traces without one direction get no curve."""
    width = params.voltage_bin_width
    checked = sweep_direction(traces, width)
    binned = bin_traces(checked, width).withColumns(
        {name: F.when(F.col("sweep_ok"), F.col(name)) for name in ("vb", "ib")}
    )
    return curve_grids(binned, params)


def potentials(traces: DataFrame, params: FitParams) -> DataFrame:
    """Curves with floating and plasma potential (``vf0_V``, ``vp_derivative_V``, ``vf_V``)."""
    shaped = curves(traces, params)
    crossed = floating_potential(shaped, "vf0_V")
    knee = plasma_potential(current_slope(crossed, params))
    return floating_potential(knee, "vf_V", bound="vp_derivative_V").withColumn(
        "vf_V",
        F.when(F.col("vp_derivative_V").isNotNull() & (F.col("vf_V") < F.col("vp_derivative_V")), F.col("vf_V")),
    )


def stages(traces: DataFrame, params: FitParams) -> DataFrame:
    """Every intermediate of the analysis, one row per trace.

    All steps are projections of the trace's own row, so the plan has no shuffle
    after the rows were formed.
    """
    return from_saturation(until_saturation(traces, params), params)


def until_saturation(traces: DataFrame, params: FitParams) -> DataFrame:
    """The steps before the temperature is sought."""
    found = potentials(traces, params)
    ions = branch_support(derivative_significance(ion_branch(found, params)), params)
    gated = early_gate(ions, params).withColumn(
        "_vp", F.when(F.col("gate").isNull(), F.col("vp_derivative_V"))
    )
    return electron_saturation(gated, params, vp="_vp")


def configurations(traces: DataFrame, settings: dict[str, FitParams]) -> dict[str, DataFrame]:
    """The stages of one table of traces under several settings.

    Settings may differ in how the temperature region is chosen. The steps before that are
    done once and written; each configuration goes on from there. Samples and grids are left out.
    """
    first = next(iter(settings.values()))
    if any(p.with_(te_region_method=first.te_region_method) != first for p in settings.values()):
        raise ValueError("configurations may differ in te_region_method only.")
    # no later step reads samples or grids
    shared = written(until_saturation(traces, first).drop("v", "i", "va", "ia", "vg", "ig", "didv"))
    return {name: from_saturation(shared, p) for name, p in settings.items()}


def from_saturation(saturated: DataFrame, params: FitParams) -> DataFrame:
    heated = fitted_plasma_potential(electron_temperature(saturated, params), params)
    checked = plateau_disagreement(electron_leakage(heated), vp="_vp")
    return final_gate(checked, params).drop("_vp")


def analyze_traces(
    traces: DataFrame,
    params: FitParams,
    keys: Sequence[str],
    with_grids: bool = False,
) -> DataFrame:
    """Fit every trace of ``traces(keys..., v ARRAY, i ARRAY)``; one result row each.

    ``with_grids`` keeps the display grid (``vg, ig, didv_grid, fit_mask``).
    """
    return fits_of(stages(traces, params), params, keys, with_grids)


def fits_of(done: DataFrame, params: FitParams, keys: Sequence[str], with_grids: bool = False) -> DataFrame:
    """The result rows of stages that were already made."""
    keep = list(keys)
    if with_grids:
        done = display_fit_mask(on_display_grid(done)).withColumn(
            "didv_grid", F.when(F.coalesce("gate", F.lit(99)) > 4, F.col("didv_grid"))
        )
        keep += ["vg", "ig", "didv_grid", "fit_mask"]
    return result_row(done, params, keep)
