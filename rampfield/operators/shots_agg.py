"""Statistics over the shots of a position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import X
from .sweep import clean

# Fit columns averaged over shots, with the name of the averaged product.
QUANTITIES = {
    "te_eV": "te_eV", "vp_V": "vp_V", "vf_V": "vf_V", "ies_A": "ies_A", "iis_A": "iis_A",
    "n_e_m3": "n_e_m3",
}
DIAGNOSTICS = {
    "te_fit_r2": "te_fit_r2", "te_fit_rmse": "te_fit_rmse_logI", "te_fit_npts": "te_fit_npts",
    "te_fit_vstart": "te_fit_vstart_V", "te_fit_vstop": "te_fit_vstop_V",
    "te_fit_slope": "te_fit_slope_logI_per_V", "te_fit_intercept": "te_fit_intercept_logI",
    "te_fit_i0": "te_fit_i0_A",
}


# --- A1 ------------------------------------------------------------------------------


def shot_statistics(
    rows: DataFrame,
    keys: Sequence[str],
    values: dict[str, str],
    valid: Column | None = None,
    counts: Sequence[str] = (),
) -> DataFrame:
    """A1: mean ``<name>``, sample deviation ``<name>_std`` and, where asked, ``<name>_count``.

    Only finite values count, accepted or not; ``valid`` narrows them further.
    The deviation is NULL below two values.
    """
    def value(column: str) -> Column:
        finite = clean(X.col(column)).column()
        return finite if valid is None else F.when(valid, finite)

    measures: list[Column] = []
    for column, name in values.items():
        measures += [
            F.avg(value(column)).alias(name), F.stddev_samp(value(column)).alias(f"{name}_std")
        ]
        if column in counts:
            measures.append(F.count(value(column)).alias(f"{name}_count"))
    return rows.groupBy(*keys).agg(*measures)


# --- A2 ------------------------------------------------------------------------------


def acceptance(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A2: per position, whether any shot was accepted, how many, and fit roll-ups."""
    return fits.groupBy(*keys).agg(*_acceptance_measures())


def _acceptance_measures() -> list[Column]:
    return [
        F.bool_or("ok").alias("analysis_ok"),
        F.count_if("ok").alias("analysis_valid_count"),
        F.bool_or("te_fit_passed_r2").alias("te_fit_passed_r2"),
        F.sum(F.col("te_fit_candidate_count").cast("bigint")).alias("te_fit_candidate_count"),
        F.count("te_eV").alias("fit_count"),
    ]


def profiles(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1 and A2 of a scan in one aggregation: the profile row of every position and ramp."""
    counted = fits.withColumn(
        "te_fit_npts", F.when(F.col("te_fit_candidate_count") > 0, F.col("te_fit_npts"))
    )
    values = {**QUANTITIES, **DIAGNOSTICS}
    measures: list[Column] = []
    for column, name in values.items():
        measures += [F.avg(column).alias(name), F.stddev_samp(column).alias(f"{name}_std")]
    return counted.groupBy(*keys).agg(
        *measures, F.count("te_fit_r2").alias("te_fit_count"), *_acceptance_measures()
    )


# --- A3 ------------------------------------------------------------------------------


def rejection_histogram(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A3: rejected traces by their last warning."""
    reason = F.coalesce(
        F.try_element_at("warnings", F.lit(-1)), F.lit("unspecified analysis failure")
    )
    return fits.where(~F.col("ok")).groupBy(*keys, reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("rejected")
    )


def status_line(fits: DataFrame, keys: Sequence[str] = (), averaged: bool = False) -> DataFrame:
    """A3: one row per key with counts, the top rejection and the status text.

    Equal counts are ordered by reason.  Traces are counted per reason first, so
    only a few rows per key meet.
    """
    reason = F.when(
        ~F.col("ok"),
        F.coalesce(F.try_element_at("warnings", F.lit(-1)), F.lit("unspecified analysis failure")),
    )
    counted = fits.groupBy(*keys, reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count("te_eV").alias("reported"),
        F.count_if("ok").alias("accepted"),
    )
    ranked = F.when(F.col("reason").isNotNull(), F.struct(-F.col("n"), F.col("reason")))
    joined = counted.groupBy(*keys).agg(
        F.sum("n").alias("traces"), F.sum("reported").alias("reported"), F.sum("accepted").alias("accepted"),
        F.min_by("reason", ranked).alias("top_reason"),
        F.max(F.when(F.col("reason").isNotNull(), F.col("n"))).alias("top_count"),
    )
    # Texts that readers of the stored status look for.
    kind = "shot-averaged fits" if averaged else "per-shot fits"
    text = F.format_string(
        f"Reported %d/%d finite {kind}; accepted %d/%d {kind}",
        F.col("reported"), F.col("traces"), F.col("accepted"), F.col("traces"),
    )
    tail = F.when(
        F.col("top_reason").isNotNull(),
        F.format_string("; top rejection (%d): %s", F.col("top_count"), F.col("top_reason")),
    )
    return joined.withColumn("status", F.concat(text, F.coalesce(tail, F.lit(""))))


# --- A4 ------------------------------------------------------------------------------


def representative_curves(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A4: mean display curve of every position over its shots: (keys, j, vg, ig, didv, fit_mask)."""
    points = fits.where("vg is not null").select(
        *keys, F.posexplode(F.arrays_zip("vg", "ig", "didv_grid", "fit_mask")).alias("j", "_p")
    )
    return points.groupBy(*keys, "j").agg(
        F.avg("_p.vg").alias("vg"), F.avg("_p.ig").alias("ig"), F.avg("_p.didv_grid").alias("didv"),
        F.bool_or("_p.fit_mask").alias("fit_mask"),
    )


# --- A5 ------------------------------------------------------------------------------


def statistics_label(mode: str, nshots: Column | int) -> tuple[Column, Column]:
    """A5: (available, stage) of the per-shot statistics of a run."""
    # The labels are stored with a run.
    if mode not in ("individual", "average"):
        raise ValueError(f"Unknown shot analysis mode {mode!r}.")
    if mode == "average":
        return F.lit(False), F.lit("unavailable; shots averaged in voltage bins before fitting")
    shots = F.lit(nshots) if isinstance(nshots, int) else nshots
    return shots >= 2, F.when(
        shots < 2, F.lit("unavailable; only one shot was configured")
    ).otherwise(F.lit("individual fits before spatial post-processing"))


def unavailable_shot_products(positions: DataFrame, nshots: int) -> DataFrame:
    """A5: one empty per-shot row for every position and shot of an averaged run."""
    nulls = {name: "double" for name in (*QUANTITIES, *DIAGNOSTICS)}
    return positions.withColumn(
        "ishot", F.explode(F.sequence(F.lit(0), F.lit(nshots - 1)))
    ).withColumns(
        {
            **{name: F.lit(None).cast(kind) for name, kind in nulls.items()},
            "ok": F.lit(False), "te_fit_passed_r2": F.lit(False), "statistics_fit": F.lit(False),
            "te_fit_candidate_count": F.lit(0),
        }
    )
