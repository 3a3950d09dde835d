"""Whole-scan analysis: raw shots to stored profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import line_density_m2
from ..operators.calibration import calibrate_line, calibrate_map, scale_deviation
from ..operators.conditioning import isat_mean, ramp_times, shot_mean_waveforms, smooth_in_time
from ..operators.shots_agg import (
    DIAGNOSTICS, QUANTITIES, profiles, representative_curves, shot_statistics, statistics_label,
    unavailable_shot_products,
)
from ..operators.spatial import process_line, process_map, reported_version
from ..operators.sweep import pool_shots
from ..params import ScanParams
from ..sources.scratch import written
from ..sources.shots import (
    channel_check, interval_check, on_grid, paired_ramps, require_complete, shot_index,
)
from ..sources.store import Staged
from ..sources.tensors import dense_blocks
from .trace import analyze_traces

RAMP = ["run", "iy", "ix", "iramp"]
SHOT = ["run", "iy", "ix", "ishot", "iramp"]
CURVES = ("vg", "ig", "didv_grid", "fit_mask")
SHOT_FLAGS = ("ok", "te_fit_passed_r2", "te_fit_candidate_count")


def scan_fits(raw_shots: DataFrame, scan: ScanParams, with_grids: bool = True) -> DataFrame:
    """One result row per trace: of every shot, or of every position in averaged mode."""
    return fitted_ramps(paired_ramps(raw_shots, scan), scan, with_grids)


def fitted_ramps(ramps: DataFrame, scan: ScanParams, with_grids: bool = True) -> DataFrame:
    """As ``scan_fits``, from ramps that were already cut and paired."""
    if scan.shot_mode == "average":
        pooled = pool_shots(ramps, RAMP, scan.fit.voltage_bin_width)
        traces = pooled.withColumn("ishot", F.lit(0))
    else:
        traces = ramps
    return analyze_traces(traces, scan.fit, SHOT, with_grids)


def scan_profiles(fits: DataFrame, isat: DataFrame, scan: ScanParams) -> DataFrame:
    """Profiles on the dense grid: shot statistics, cleaning, reported version, calibration."""
    means = profiles(fits, RAMP)
    runs = means.select("run", "iramp").distinct()
    dense = on_grid(runs, scan).join(means, RAMP, "left").join(isat, RAMP, "left")
    by = ["run", "iramp"]
    options = {
        "reject": scan.enable_spike_rejection, "spike_half_window": scan.spike_half_window,
        "threshold": scan.spike_threshold_V, "replace": scan.replace_spikes,
        "smooth": scan.enable_smoothing, "smooth_half_window": scan.smooth_half_window,
        "sigma": scan.smooth_sigma,
    }
    process = process_line if scan.geometry == "x_line" else process_map
    cleaned = reported_version(
        process(dense, by, **options), scan.enable_spike_rejection, scan.enable_smoothing
    )
    if scan.calibrate_density:
        density = line_density_m2(scan.frequency_GHz, scan.phase_rad, scan.passes)
        if scan.geometry == "x_line":
            scaled = calibrate_line(cleaned, by, density)
        else:
            scaled = calibrate_map(cleaned, by, density, scan.calibration_y_cm)
        cleaned = scale_deviation(scaled, ["run"], scan.nramps).withColumn(
            "n_e_m3", F.col("n_e_scaled_m3")
        ).drop("n_e_scaled_m3")
    return ramp_times(cleaned, scan).withColumn("geometry", F.lit(scan.geometry))


def scan_isat(ramps: DataFrame, scan: ScanParams) -> DataFrame:
    """P6 with A1: mean and deviation of the Isat window over shots."""
    return isat_statistics(isat_mean(ramps, scan), scan)


def isat_statistics(currents: DataFrame, scan: ScanParams) -> DataFrame:
    out = shot_statistics(currents, RAMP, {"isat_A": "isat_A"})
    if scan.shot_mode == "average":
        out = out.withColumn("isat_A_std", F.lit(None).cast("double"))
    return out


def run_settings(scan: ScanParams) -> dict[str, Column]:
    """Settings of a run as columns of the ``runs`` table: acquisition, conditioning and fit."""
    available, stage = statistics_label(scan.shot_mode, scan.nshots)
    fit = scan.fit
    return {
        "geometry": F.lit(scan.geometry), "nx": F.lit(scan.nx), "ny": F.lit(scan.ny),
        "nshots": F.lit(scan.nshots), "nramps": F.lit(scan.nramps),
        "nt_full": F.lit(scan.nt_full), "nt_sweep": F.lit(scan.ramp_length),
        "dt_s": F.lit(scan.dt_s), "shot_analysis_mode": F.lit(scan.shot_mode),
        "shot_statistics_available": available, "shot_statistics_stage": stage,
        "te_min_r2": F.lit(fit.te_min_r2), "ies_method": F.lit(fit.ies_method),
        "te_region_method": F.lit(fit.te_region_method),
        "acquired_traces": F.lit(scan.positions * scan.nshots),
        "line_density_m2": F.lit(line_density_m2(scan.frequency_GHz, scan.phase_rad, scan.passes) if scan.calibrate_density else None).cast("double"),
        "settings": F.create_map(
            *[F.lit(str(x)) for name, value in vars(fit).items() for x in (name, value)]
        ),
        "acquisition": F.create_map(
            *[F.lit(str(x)) for name, value in vars(scan).items() if name != "fit" for x in (name, value)]
        ),
    }


def shot_products(ramps: DataFrame, fits: DataFrame, scan: ScanParams) -> DataFrame:
    """Products of every shot and ramp: saturation current, baseline, smoothed signals, fit and curve.

    In averaged mode no shot has a fit of its own: its fit columns are NULL, its flags false.
    """
    from_signals = smooth_in_time(isat_mean(ramps, scan), scan.sg_window, scan.sg_order).select(
        *SHOT, "shotnum", "isat_A", F.when(F.lit(scan.subtract_dc), F.col("dc_offset_A")).alias("dc_offset_A"),
        F.col("v_smooth").alias("v_smooth_V"), F.col("i_smooth").alias("i_smooth_A"),
    )
    if scan.shot_mode == "average":
        empty = unavailable_shot_products(from_signals.select("run", "iy", "ix", "iramp").distinct(), scan.nshots)
        curves = {name: F.lit(None).cast("array<double>") for name in CURVES[:3]}
        return from_signals.join(empty, SHOT, "left").withColumns({**curves, "fit_mask": F.lit(None).cast("array<boolean>")})
    own = fits.select(*SHOT, *QUANTITIES, *DIAGNOSTICS, *SHOT_FLAGS, *CURVES)
    return from_signals.join(own, SHOT, "left").withColumn("statistics_fit", F.col("te_eV").isNotNull())


def exported_arrays(shots: DataFrame, cleaned: DataFrame, grid: DataFrame, scan: ScanParams) -> DataFrame:
    """SNK2: profiles, shot products, waveforms' smoothed signals and curve grids as tensors in blocks."""
    axes = {"iy": scan.ny if scan.geometry == "xy_plane" else 1, "ix": scan.nx}
    ramp = {"iramp": scan.nramps}
    per_shot = {**axes, "ishot": scan.nshots, **ramp}

    def numbers(df: DataFrame) -> list[str]:
        return [n for n, k in df.dtypes if n not in (*SHOT, "shotnum") and k in ("double", "float", "int", "bigint", "boolean")]

    def tagged(df: DataFrame, product: str) -> DataFrame:
        return df.withColumn("product", F.lit(product))

    points = scan.fit.iv_npts
    lists = F.sort_array(F.collect_list(F.struct("j", "vg", "ig", "didv", F.col("fit_mask").cast("double").alias("fit_mask"))))
    curves = grid.groupBy(*RAMP).agg(lists.alias("_g")).select(*RAMP, *[F.col(f"_g.{n}").alias(n) for n in ("vg", "ig", "didv", "fit_mask")])
    parts = [
        tagged(dense_blocks(cleaned, ["run"], {**axes, **ramp}, numbers(cleaned)), "profile"),
        tagged(dense_blocks(shots, ["run"], per_shot, numbers(shots)), "shot"),
        tagged(dense_blocks(shots, ["run"], per_shot, ["v_smooth_V", "i_smooth_A"], scan.ramp_length), "shot"),
        tagged(dense_blocks(shots, ["run"], per_shot, list(CURVES), points, "point"), "shot"),
        tagged(dense_blocks(curves, ["run"], {**axes, **ramp}, ["vg", "ig", "didv", "fit_mask"], points, "point"), "curve"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checked_runs(raw_shots: DataFrame, scan: ScanParams) -> DataFrame:
    """(run, violation) of every run, from its shot index; signals are read, once, only where lengths were not stored."""
    index = shot_index(raw_shots)
    if "n_samples" not in raw_shots.columns:
        index = written(index)
    of = lambda channel, name: channel_check(index, scan, channel).select("run", F.col("violation").alias(name))
    both = of(scan.voltage_channel, "_v").join(of(scan.current_channel, "_i"), "run")
    timed = both.join(interval_check(index, scan).withColumnRenamed("violation", "_t"), "run")
    return timed.select("run", F.coalesce("_v", "_i", "_t").alias("violation"))


def run_scan(
    spark: SparkSession, raw_shots: DataFrame, scan: ScanParams, root: str, runs: Sequence[str] | None = None,
    incomplete: str = "refuse",
) -> DataFrame:
    """Analyse a scan and store every product under ``root``; returns (run, violation) of all runs.

    ``runs`` narrows the shots before anything else is done. A run that is not complete ends the
    call with an error, or with ``incomplete`` "skip" is left out. Raw signals are read once for
    each channel, and once before that where their lengths were not stored: ramps are cut, paired
    and written, and every product starts from that table or from a stored one. All tables of the runs are committed together at the end.
    """
    if incomplete not in ("refuse", "skip"):
        raise ValueError("incomplete must be 'refuse' or 'skip'")
    raw = raw_shots if runs is None else raw_shots.where(F.col("run").isin(*runs))
    checked = written(checked_runs(raw, scan))
    if incomplete == "refuse":
        require_complete(checked)
    usable = checked.where("violation is null").select("run")
    ramps = written(paired_ramps(raw.join(usable, "run", "left_semi"), scan))
    staged, geometry = Staged(spark, root), F.lit(scan.geometry)

    def store(df: DataFrame, table: str) -> DataFrame:
        return staged.write(df.withColumn("geometry", geometry), table).drop("geometry")

    fits = store(fitted_ramps(ramps, scan), "fits")
    shots = store(shot_products(ramps, fits, scan), "shots")
    isat = isat_statistics(shots.select(*RAMP, "isat_A"), scan)
    cleaned = store(scan_profiles(fits, isat, scan).drop("geometry"), "profiles")
    grid = store(representative_curves(fits, RAMP), "iv_grid")
    smooth = shots.select(*SHOT, F.col("v_smooth_V").alias("v_smooth"), F.col("i_smooth_A").alias("i_smooth"))
    waves = shot_mean_waveforms(ramps.select(*SHOT, "v", "i").join(smooth, SHOT), RAMP, scan.dt_s)
    store(waves, "waveforms")
    store(exported_arrays(shots, cleaned, grid, scan), "arrays")
    found = usable
    if scan.calibrate_density and scan.nramps == 1:
        # one ramp has one factor
        factors = cleaned.groupBy("run").agg(F.max("shape_factor_m").alias("shape_factor_m"), F.max("density_scale").alias("density_scale"))
        found = usable.join(factors, "run", "left")
    store(found.withColumns(run_settings(scan)), "runs")
    staged.commit(usable.withColumn("geometry", geometry))
    return checked
