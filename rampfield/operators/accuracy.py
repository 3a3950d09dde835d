"""Comparison of fits with known truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import SIGNAL_TO_NOISE
from ..sources.scratch import written
from .keys import exact_quantiles


def percent_errors(fits: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V1: adds percent errors of Te and density; ``truth`` has true_te_eV and true_ne_m3."""
    return fits.join(truth, list(keys)).withColumns(
        {
            "te_error_percent": 100 * (F.col("te_eV") / F.col("true_te_eV") - 1),
            "ne_error_percent": 100 * (F.col("n_e_m3") / F.col("true_ne_m3") - 1),
        }
    )


def error_table(errors: DataFrame, groups: Sequence[str]) -> DataFrame:
    """V1: accepted count and 5/50/95 % quantiles of the errors of accepted fits."""
    names = ("te_error_percent", "ne_error_percent")
    # counts and quantiles each read the errors, whose fits are dear
    errors = written(errors.select(*groups, "ok", *names))
    accepted = errors.where("ok")
    table = errors.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("accepted")
    )
    for name in names:
        quantiles = exact_quantiles(accepted, groups, name, (0.05, 0.5, 0.95), name)
        table = table.join(quantiles, list(groups), "left")
    return table.select(
        *groups, "cases", "accepted",
        *[
            F.col(name)[i].alias(f"{name}_{label}")
            for name in names
            for i, label in enumerate(("p05", "p50", "p95"))
        ],
    )


def beam_comparison(
    ordinary: DataFrame, bounded: DataFrame, bulk: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """V2: ordinary fit, bounded fit and bulk candidate of every case side by side."""
    names = list(keys)
    left = ordinary.select(
        *names, F.col("te_eV").alias("ordinary_te_eV"), F.col("ok").alias("ordinary_ok"),
        F.col("te_fit_vstart").alias("ordinary_vstart_V"),
        F.col("te_fit_vstop").alias("ordinary_vstop_V"),
        F.array_join("warnings", " | ").alias("ordinary_warnings"),
        "ion_current_A", "ion_current_uncertainty_A",
    )
    right = bounded.select(
        *names, F.col("te_eV").alias("bounded_te_eV"), F.col("ok").alias("bounded_ok")
    )
    chosen = bulk.where("is_bulk").select(
        *names, F.col("bg.te_eV").alias("bulk_candidate_te_eV"),
        F.col("width_V").alias("bulk_candidate_width_V"),
        F.col("bg.vstart_V").alias("bulk_candidate_vstart_V"),
        F.col("bg.vstop_V").alias("bulk_candidate_vstop_V"),
        "bulk_signal_vstart_V", "bulk_signal_vstop_V",
        F.col("bg.background_at_vmax_A").alias("_level"),
        F.col("bg.background_at_vmax_uncertainty_A").alias("_error"),
    )
    joined = left.join(right, names).join(chosen, names, "left")
    excess = F.col("_level") - F.col("ion_current_A")
    error = F.hypot("_error", "ion_current_uncertainty_A")
    return joined.withColumns(
        {
            "bulk_candidate_found": F.col("bulk_candidate_te_eV").isNotNull(),
            "excess_background_A": excess,
            "excess_background_5sigma": F.coalesce(excess > SIGNAL_TO_NOISE * error, F.lit(False)),
        }
    ).drop("_level", "_error", "ion_current_A", "ion_current_uncertainty_A")
