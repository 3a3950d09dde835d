"""Sources, statistics, spatial cleaning, calibration, series and the stored scan."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampfield.functions.kernels import butterworth_sections
from rampfield.functions.text import X
from rampfield.operators import calibration as K
from rampfield.operators import conditioning as C
from rampfield.operators import fields as L
from rampfield.operators import lowpass
from rampfield.operators import spatial as G
from rampfield.operators.keys import attach_by_key, exact_quantiles, position_in_group
from rampfield.params import FitParams, ScanParams
from rampfield.plans.scan import run_scan
from rampfield.sources import geometry, results, shots
from rampfield.sources.store import Staged, read_table, remove_replaced
from rampfield.sources.tensors import dense_blocks, tensor_cells


def scan(**changes):
    values = dict(
        geometry="xy_plane", nx=2, ny=2, nshots=1, nt_full=3, dt_s=1e-6, x_min_cm=0.0, x_max_cm=1.0,
        y_min_cm=0.0, y_max_cm=1.0, sweep_start=0, sweep_end=2, voltage_channel=1, current_channel=2,
        sg_window=3, sg_order=1,
    )
    return ScanParams(**{**values, **changes})


def test_descending_rows_are_flipped(spark):
    raw = spark.createDataFrame(
        [("r", 1, 1, s, [float(s)] * 3, 1e-6) for s in range(1, 5)],
        "run string, board int, channel int, shotnum long, signal array<float>, dt_s double",
    )
    got = {r["shotnum"]: (r["iy"], r["ix"]) for r in shots.with_position(raw, scan()).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (0, 0), 4: (0, 1)}


def test_ramps_are_cut_at_even_spacing(spark):
    s = scan(geometry="x_line", nt_full=20, sweep_start=2, sweep_end=5, nramps=3, ramp_spacing=6)
    row = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: x.cast("double")).alias("y")
    ).select(C.ramps_of(X.col("y"), s).column().alias("r")).first()
    assert [[int(x) for x in r] for r in row["r"]] == [[2, 3, 4, 5], [8, 9, 10, 11], [14, 15, 16, 17]]


def test_missing_shots_are_reported(spark):
    raw = spark.createDataFrame(
        [("r", 1, 1, s, [0.0] * 3, 1e-6) for s in (1, 2, 4)],
        "run string, board int, channel int, shotnum long, signal array<float>, dt_s double",
    )
    with pytest.raises(ValueError, match="shot count"):
        shots.require_complete(shots.channel_check(raw, scan(), 1))


@pytest.mark.parametrize("dt", [20e-9, 40e-9, 320e-9])
def test_half_samples_round_up(spark, dt):
    rows = [(k, (k + 0.5) * dt) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, t double")
    assert all(
        r["s"] == r["k"] + 1
        for r in df.select("k", C.time_to_sample(F.col("t"), F.lit(dt)).alias("s")).collect()
    )


def test_settings_in_seconds():
    common = dict(geometry="x_line", nx=2, nshots=1, nt_full=900, x_min_cm=0.0, x_max_cm=1.0, sg_window=3, sg_order=1, subtract_dc=True)
    times = {"sweep_start": 20.5e-6, "sweep_end": 99.4e-6, "dc_start": 0.0, "dc_end": 5e-6}
    s = ScanParams.timed(dt_s=1e-6, times_s=times, **common)
    assert (s.sweep_start, s.sweep_end, s.dc_start, s.dc_end) == (21, 99, 0, 5)
    from rampfield.params import nearest_sample

    for dt in (20e-9, 40e-9, 320e-9):
        assert [nearest_sample(float(f"{(k + 0.5) * dt:.12g}"), dt) for k in range(300)] == list(range(1, 301))
    for bad in ({"nx": 1e-6}, {"sweep_start": -1e-6}, {"sweep_start": float("nan")}):
        with pytest.raises(ValueError):
            ScanParams.timed(dt_s=1e-6, times_s={**times, **bad}, **common)
    with pytest.raises(ValueError, match="twice"):
        ScanParams.timed(dt_s=1e-6, times_s=times, sweep_end=5, **common)


def profile(spark, rows):
    return spark.createDataFrame(rows, "run string, iy int, ix int, iramp int, vp_V double, x_cm double")


def test_line_spike_is_flagged_per_ramp(spark):
    rows = [("r", 0, x, 0, v, float(x)) for x, v in enumerate((1.0, 1.0, 20.0, 1.0, 1.0))]
    rows += [("r", 0, x, 1, 100.0, float(x)) for x in range(5)]
    flagged = G.flag_line_spikes(profile(spark, rows), "vp_V", ["run", "iramp"], 1, 5.0)
    # Points beside the spike see the median of {1, 20} and are flagged as well; the
    # second ramp never is.
    assert sorted((r["iramp"], r["ix"]) for r in flagged.where("spike").collect()) == [(0, 1), (0, 2), (0, 3)]
    fixed = G.replace_line_spikes(flagged, "vp_V", "spike", ["run", "iramp"])
    assert fixed.where("iramp = 0").agg(F.max("vp_V")).first()[0] == 1.0


def test_map_spike_is_replaced(spark):
    rows = [("r", y, x, 0, 20.0 if (y, x) == (1, 1) else 1.0, 0.0) for y in range(3) for x in range(3)]
    rows += [("r", y, x, 1, 100.0, 0.0) for y in range(3) for x in range(3)]
    by = ["run", "iramp"]
    flagged = G.flag_map_spikes(profile(spark, rows), "vp_V", by, (1, 1), 5.0)
    assert [(r["iramp"], r["iy"], r["ix"]) for r in flagged.where("spike").collect()] == [(0, 1, 1)]
    fixed = G.replace_map_spikes(flagged, "vp_V", "spike", by)
    assert {r["iramp"]: r["m"] for r in fixed.groupBy("iramp").agg(F.max("vp_V").alias("m")).collect()} == {0: 1.0, 1: 100.0}


def test_line_calibration_per_ramp(spark):
    rows = [("r", 0, x, 0, n, x * 10.0 - 10) for x, n in enumerate((1.0, 2.0, 1.0))]
    rows += [("r", 0, x, 1, n, x * 10.0 - 10) for x, n in enumerate((1.0, 4.0, 1.0))]
    line = profile(spark, rows).withColumnRenamed("vp_V", "n_e_m3")
    done = K.calibrate_line(line, ["run", "iramp"], 4e17)
    got = {r["iramp"]: (r["shape_factor_m"], r["top"]) for r in done.groupBy("iramp").agg(
        F.max("shape_factor_m").alias("shape_factor_m"), F.max("n_e_scaled_m3").alias("top")).collect()}
    assert got[0] == pytest.approx((0.15, 4e17 / 0.15))
    assert got[1] == pytest.approx((0.125, 4e17 / 0.125))


def test_map_calibration_uses_the_nearest_row(spark):
    y = (-2.0, 1.0, 4.0)
    n = ((0.5, 1, 0.5), (1, 2, 1), (1.5, 3, 1.5))
    cells = spark.createDataFrame(
        [("r", 0, j, x, x * 10.0 - 10, y[j], n[j][x] * 1e16) for j in range(3) for x in range(3)],
        "run string, iramp int, iy int, ix int, x_cm double, y_cm double, n_e_m3 double",
    )
    done = K.calibrate_map(cells, ["run", "iramp"], 6e15, 0.0)
    row = done.select("row_iy", "shape_factor_m", "density_scale").distinct().collect()
    assert len(row) == 1 and row[0]["row_iy"] == 1
    assert row[0]["shape_factor_m"] == pytest.approx(0.15) and row[0]["density_scale"] == pytest.approx(2.0)


def test_geometry_of_motion_lists(spark):
    rows = [("line", 11 + 2 * k + r, x, 0.0, "cm") for k, x in enumerate((-1.0, 0.0, 1.0)) for r in range(2)]
    rows += [("uneven", 11 + k, x, 0.0, "cm") for k, x in enumerate((-1.0, 0.0, 2.0))]
    rows += [("repeats", 11 + k, x, 0.0, "cm") for k, x in enumerate((-1.0, -1.0, 0.0, 1.0, 1.0, 2.0))]
    rows += [("revisit", 11 + k, x, 0.0, "cm") for k, x in enumerate((0.0, 1.0, 0.0, 1.0))]
    df = spark.createDataFrame(rows, "config string, shotnum long, x double, y double, unit string")
    got = {r["config"]: r for r in geometry.infer_geometry(df, "x_line").collect()}
    ok = got["line"]
    assert (ok["violation"], ok["nshots"], ok["data_offset"], ok["nx"]) == (None, 2, 10, 3)
    assert "even" in got["uneven"]["violation"] and "repeats" in got["repeats"]["violation"]
    assert "revisited" in got["revisit"]["violation"]


def test_plane_geometry_descends(spark):
    rows, shot = [], 21
    for y in (1.0, 0.0):
        for x in (0.0, 1.0, 2.0):
            for _ in range(3):
                rows.append(("p", shot, x, y, "cm"))
                shot += 1
    df = spark.createDataFrame(rows, "config string, shotnum long, x double, y double, unit string")
    r = geometry.infer_geometry(df, "xy_plane").first()
    assert (r["violation"], r["nx"], r["ny"], r["nshots"], r["y_order"]) == (None, 3, 2, 3, "descending")


# --- series --------------------------------------------------------------------------


def direct_zero_phase(x, order, cutoff, fs):
    """Plain two-pass filter with odd extension, sample by sample."""
    sections = butterworth_sections(order, cutoff, fs)
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])

    def once(y):
        level = y[0]
        for b0, b1, b2, a1, a2 in sections:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z0, z1 = level * (gain - b0), level * (b2 - a2 * gain)
            out = np.empty_like(y)
            for k, s in enumerate(y):
                out[k] = b0 * s + z0
                z0, z1 = b1 * s - a1 * out[k] + z1, b2 * s - a2 * out[k]
            y, level = out, level * gain
        return y

    return once(once(ext)[::-1])[::-1][pad : pad + len(x)]


@pytest.mark.parametrize("group", [2, 3, 1024])
def test_butterworth_over_chunks_equals_direct_filter(spark, monkeypatch, group):
    """Also with few chunks in a group, so that states pass over several groups."""
    monkeypatch.setattr(lowpass, "GROUP", group)
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 0.01 * t), 0.5 * np.sin(2 * np.pi * 0.3 * t)
    cases = {1: slow + fast, 2: np.linspace(-3, 5, 400), 3: slow[:9], 4: fast[:37], 5: fast[:38], 6: slow[:2], None: fast[:111]}
    df = spark.createDataFrame(
        [(s, k, float(x)) for s, xs in cases.items() for k, x in enumerate(xs)], "s int, k long, value double"
    ).repartition(5)
    rows = lowpass.butterworth(df, ["s"], cutoff=0.05, fs=1.0, order=5, chunk=37).collect()
    of = lambda s: sorted((r for r in rows if r["s"] == s), key=lambda r: r["k"])
    for s, xs in cases.items():
        got = of(s)
        assert [r["k"] for r in got] == list(range(len(xs)))
        assert np.allclose([r["smooth"] for r in got], direct_zero_phase(xs, 5, 0.05, 1.0), atol=1e-9)
    smooth = np.array([r["smooth"] for r in of(1)])
    assert np.abs(smooth[50:-50] - slow[50:-50]).max() < 0.01
    # Away from the start-up transient of its ends a ramp passes unchanged.
    line = np.array([r["smooth"] for r in of(2)])
    assert np.allclose(line[150:250], cases[2][150:250], atol=1e-4)


def test_butterworth_of_gaps_short_and_empty_series(spark):
    rows = [(1, k, float(k)) for k in range(60)] + [(2, k, None if k == 50 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "s int, k int, value double")
    got = lowpass.butterworth(df, ["s"], cutoff=0.1, dt=1.0, order=3, chunk=20).collect()
    assert len(got) == 120 and all((r["smooth"] is None) == (r["s"] == 2) for r in got)
    with pytest.raises(Exception, match="at least 2 samples"):
        lowpass.butterworth(df.where("k = 0"), ["s"], cutoff=0.1, fs=1.0).collect()
    assert lowpass.butterworth(df.where("k < 0"), ["s"], cutoff=0.1, fs=1.0).collect() == []
    for bad in ({}, {"fs": -1.0}, {"fs": 0.1}, {"fs": 1.0, "chunk": 8}):
        with pytest.raises(ValueError):
            lowpass.butterworth(df, ["s"], cutoff=0.1, **bad)


def test_rotation_angle_is_found(spark):
    t = np.linspace(0, 20, 500)
    a = 0.3
    main = np.sin(t)
    df = spark.createDataFrame(
        [(0, k, float(math.cos(a) * m), float(math.sin(a) * m)) for k, m in enumerate(main)],
        "s int, k long, by double, bz double",
    )
    r = L.rotation_angles(df, ["s"]).first()
    assert r["theta_rad"] == pytest.approx(a) and r["var_bz_prime"] == pytest.approx(0.0, abs=1e-12)


def test_hot_key_is_spread_and_ranked(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"), F.col("id").alias("t")
    )
    ranked = position_in_group(rows, ["key"], ["t"], "pos")
    hot = ranked.where("key = 0").orderBy("t").select("pos").collect()
    assert [r["pos"] for r in hot] == list(range(1000))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    joined = attach_by_key(rows, counts, ["key"])
    assert joined.count() == 3000 and joined.where("key = 0 and n = 1000").count() == 1000


def test_exact_quantiles_of_a_hot_key(spark):
    rng = np.random.default_rng(11)
    groups = {0: np.round(rng.normal(size=4000), 2), 1: rng.normal(size=7), 2: np.ones(50), 3: np.array([4.0])}
    df = spark.createDataFrame(
        [(g, float(x)) for g, xs in groups.items() for x in xs] + [(0, None)], "g int, x double"
    )
    probabilities = (0.05, 0.5, 0.95, 1.0)
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", probabilities, "q").collect()}
    for g, xs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(xs, probabilities)), abs=1e-12)


# --- whole scan ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def raw_scan(spark):
    """Two positions, three shots, two ramps of a closed-form trace."""
    rows = []
    ramp = np.linspace(-20, 18, 400)
    ies, te, vp = 2e-3, 3.0, 10.0
    cur = ies * np.exp(np.minimum((ramp - vp) / te, 0)) - 2e-4 * np.where(
        ramp <= vp, 1, np.exp(-np.maximum(ramp - vp, 0) / 0.2)
    )
    pad = np.zeros(20)
    for shot in range(1, 7):
        v = np.concatenate([pad, ramp, pad, ramp, pad])
        i = np.concatenate([pad, cur, pad, cur, pad])
        rows.append(("r", 1, 1, shot, v.tolist(), 1e-6))
        rows.append(("r", 1, 2, shot, i.tolist(), 1e-6))
    return spark.createDataFrame(
        rows, "run string, board int, channel int, shotnum long, signal array<float>, dt_s double"
    ).repartition(2)


@pytest.mark.parametrize("mode, fits", [("individual", 12), ("average", 4)])
def test_scan_is_stored_and_read_back(spark, raw_scan, mode, fits):
    s = ScanParams(
        geometry="x_line", nx=2, nshots=3, nt_full=860, dt_s=1e-6, x_min_cm=-1.0, x_max_cm=1.0,
        sweep_start=20, sweep_end=419, nramps=2, ramp_spacing=420, voltage_channel=1, current_channel=2,
        subtract_dc=True, dc_start=0, dc_end=15, isat_start=0, isat_end=10, sg_window=17, sg_order=1,
        shot_mode=mode, calibrate_density=True, phase_rad=2.0,
        fit=FitParams(iv_npts=32, voltage_bin_width=0.2, vp_smoothing_width_V=1.0, probe_area=4e-6,
                      current_zero_calibrated=True, te_region_method="bounded"),
    )
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    run_scan(spark, raw_scan, s, root)
    assert read_table(spark, root, "fits").count() == fits
    rows = results.read_results(spark, root).collect()
    assert len(rows) == 4 and all(r["te_eV"] == pytest.approx(3.0, rel=0.05) for r in rows)
    assert all(r["analysis_valid_count"] == (3 if mode == "individual" else 1) for r in rows)
    assert read_table(spark, root, "waveforms").count() == 2 * 2 * 400
    assert read_table(spark, root, "iv_grid").count() == 2 * 2 * 32
    info = read_table(spark, root, "runs").first()
    assert info["shot_statistics_available"] == (mode == "individual")
    with pytest.raises(KeyError):
        results.read_results(spark, root, fields=["nothing"])
    with pytest.raises(ValueError, match="no xy_plane"):
        results.read_results(spark, root, "xy_plane")


def small_scan(**changes):
    return ScanParams(**{**dict(
        geometry="x_line", nx=2, nshots=3, nt_full=860, dt_s=1e-6, x_min_cm=-1.0, x_max_cm=1.0, sweep_start=20, sweep_end=419,
        nramps=2, ramp_spacing=420, subtract_dc=True, dc_start=0, dc_end=15, sg_window=17,
        fit=FitParams(iv_npts=32, voltage_bin_width=0.2, vp_smoothing_width_V=1.0, probe_area=4e-6,
                      current_zero_calibrated=True, te_region_method="bounded"),
    ), **changes})


def test_a_later_scan_leaves_the_settings_of_earlier_runs(spark, raw_scan):
    from pyspark.sql import functions as F

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    run_scan(spark, raw_scan, small_scan(), root)
    later = small_scan(fit=small_scan().fit.with_(te_min_r2=0.97))
    run_scan(spark, raw_scan.withColumn("run", F.lit("second")), later, root)
    kept = {r["run"]: r["te_min_r2"] for r in read_table(spark, root, "runs").collect()}
    assert kept == {"r": small_scan().fit.te_min_r2, "second": 0.97}


def test_incomplete_scans_are_refused(spark, raw_scan):
    from pyspark.sql import functions as F

    current, first = F.col("channel") == 2, F.col("shotnum") == 1
    cases = {
        "channel absent": raw_scan.where(~current),
        "shots stored twice": raw_scan.union(raw_scan.where(current & first)),
        "shot count": raw_scan.where(~(current & first)),
        "different sample intervals": raw_scan.withColumn("dt_s", F.when(current, 2e-6).otherwise(F.col("dt_s"))),
    }
    for message, raw in cases.items():
        with pytest.raises(ValueError, match=message):
            run_scan(spark, raw, small_scan(), "/nowhere")
    stored_timing = small_scan(timing_source="hdf5", dt_s=3e-6)
    with pytest.raises(ValueError, match="interval changed"):
        run_scan(spark, raw_scan, stored_timing, "/nowhere")
    with pytest.raises(ValueError, match="missing sample interval"):
        run_scan(spark, raw_scan.withColumn("dt_s", F.lit(None).cast("double")), stored_timing, "/nowhere")


def test_doubled_signals_are_all_kept(spark):
    from checks.common import SIGNAL_SCAN, raw_signals
    from pyspark.sql import functions as F

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.range(2500).select(
        F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding")
    ).write.parquet(f"{folder}/embeddings.parquet")
    raw = raw_signals(spark, folder)
    assert shots.channel_shots(raw, SIGNAL_SCAN, 0).count() == 1250
    assert shots.paired_ramps(raw, SIGNAL_SCAN).count() == 3 * 1250
    found = {r["run"]: r["violation"] for r in shots.channel_check(raw, SIGNAL_SCAN, 1).collect()}
    assert found == {"e0": None, "e1": "shot count mismatch"}
    outside = shots.with_position(raw.limit(1).withColumn("shotnum", F.lit(1001)), SIGNAL_SCAN).first()
    assert outside["iy"] is None and outside["ix"] is None and outside["ishot"] is None


def test_null_and_frequent_keys_are_kept(spark):
    from pyspark.sql import functions as F
    from rampfield.operators.keys import attach_by_key, position_in_group

    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("key"), F.col("id").alias("at"))
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert {(r["key"], r["n"]) for r in attach_by_key(rows, per_key, ["key"]).distinct().select("key", "n").collect()} == {
        (None, 900), (0, 34), (1, 33), (2, 33)}
    placed = position_in_group(rows, ["key"], ["at"], "place")
    assert placed.count() == 1000 and placed.where("key is null").agg(F.max("place")).first()[0] == 899


def test_channel_entries_are_compared(spark):
    from rampfield.sources import sampling

    rows = [(1, 0, 64, 1e-6), (1, 1, 64, 1e-6), (2, 0, 1, 1e-6), (2, 1, 1, 1e-6), (3, 0, 64, 1e-6), (3, 0, 60, 2e-6), (3, 1, 64, 1e-6)]
    specs = spark.createDataFrame(rows, "pair long, channel int, nt int, dt_s double")
    found = {r["pair"]: r["violation"] for r in sampling.channel_agreement(specs, ["pair"], 0, 1).collect()}
    assert found == {1: None, 2: "fewer than two samples", 3: "several entries of a channel"}


def test_scan_parameters_are_checked():
    for bad in (
        {"geometry": "x"}, {"sweep_end": 9}, {"x_min_cm": 2.0}, {"nramps": 2, "ramp_spacing": 1},
        {"subtract_dc": True}, {"subtract_dc": True, "dc_start": 0, "dc_end": 1}, {"isat_end": 7}, {"sg_window": 9},
    ):
        with pytest.raises(ValueError):
            scan(**bad)


def test_single_entries_reach_every_comparison(spark, tmp_path):
    from checks.fields import reg

    cust = [0, 0, 0, 1, 0, 2, 2, 2, 4]
    orders = spark.createDataFrame(list(enumerate(cust)), "o_orderkey bigint, o_custkey bigint")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = lambda name: {r.pair: r.violation for r in reg.queries[name](spark, str(tmp_path)).collect()}
    lengths, intervals, missing = "different trace lengths", "different sample intervals", "missing trace length"
    assert found("SRC7_channel_agreement_single") == {0: None, 1: lengths, 2: intervals, 3: None, 4: missing}
    changed = "voltage interval changed"
    assert found("SRC7_resolved_interval_single") == {0: changed, 1: changed, 2: intervals, 3: None, 4: missing}


# --- store, index and export ---------------------------------------------------------


def test_a_failed_write_changes_no_table(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = lambda n, run="007": spark.range(n).select(F.lit("x_line").alias("geometry"), F.lit(run).alias("run"), "id")

    def write(n, run="007", fail=False):
        staged = Staged(spark, root)
        staged.write(rows(n, run), "fits")
        if fail:
            raise OSError("lost between two tables")
        staged.write(rows(n, run), "shots")
        staged.commit(rows(n, run))

    sizes = lambda: {(t, r["run"]): r["count"] for t in ("fits", "shots") for r in read_table(spark, root, t).groupBy("run").count().collect()}
    write(3)
    write(5, "b")
    before = sizes()
    assert before == {("fits", "007"): 3, ("shots", "007"): 3, ("fits", "b"): 5, ("shots", "b"): 5}
    with pytest.raises(OSError):
        write(4, fail=True)
    assert sizes() == before
    write(2)
    assert sizes() == {**before, ("fits", "007"): 2, ("shots", "007"): 2}
    # the replaced and the failed version go, those in use stay
    assert remove_replaced(spark, root) == []
    assert len(remove_replaced(spark, root, older_than_s=0)) == 2
    assert sizes() == {**before, ("fits", "007"): 2, ("shots", "007"): 2}
    with pytest.raises(ValueError):
        Staged(spark, root).write(rows(1), "nothing")


def test_table_without_rows_is_read(spark, tmp_path):
    root = str(tmp_path / "store")
    row = spark.range(1).select(F.lit("x_line").alias("geometry"), F.lit("r").alias("run"), "id")
    staged = Staged(spark, root)
    assert staged.write(row.where("id > 5"), "fits").count() == 0
    staged.commit(row)
    assert read_table(spark, root, "fits").collect() == [] and "id" in read_table(spark, root, "fits").columns


def test_blocks_hold_every_cell(spark):
    rng = np.random.default_rng(4)
    cells = [(r, y, x, float(rng.normal()), [float(v) for v in rng.normal(size=int(rng.integers(0, 6)))] if rng.random() > 0.2 else None)
             for r in ("a", "b") for y in range(3) for x in range(7) if rng.random() > 0.4]
    df = spark.createDataFrame(cells + cells[:1], "run string, iy int, ix int, v double, g array<double>")
    axes = {"iy": 3, "ix": 7}
    flat = {r: np.full(21, np.nan) for r in "ab"}
    deep = {r: np.full((21, 4), np.nan) for r in "ab"}
    for r, y, x, v, g in cells:
        flat[r][y * 7 + x] = v
        deep[r][y * 7 + x, : len((g or [])[:4])] = (g or [])[:4]
    for elements in (5, 4096):
        for field, length, want in (("v", None, flat), ("g", 4, {r: d.ravel() for r, d in deep.items()})):
            blocks = dense_blocks(df, ["run"], axes, [field], length, elements=elements)
            got = {r: np.full(len(want[r]), 7e77) for r in "ab"}
            for b in blocks.collect():
                assert b["axis_order"] == ("iy,ix" if length is None else "iy,ix,sample") and b["shape"] == ([3, 7] if length is None else [3, 7, 4])
                assert len(b["values"]) <= max(elements, 4)
                got[b["run"]][b["offset"] : b["offset"] + len(b["values"])] = [np.nan if v is None else v for v in b["values"]]
            assert all(np.array_equal(got[r], want[r], equal_nan=True) for r in "ab")
            listed = tensor_cells(blocks, ["run"]).where("run = 'a'").orderBy("index").collect()
            assert [c["index"] for c in listed] == list(range(len(want["a"])))
    assert dense_blocks(df.where("iy > 9"), ["run"], axes, ["v"]).collect() == []


@pytest.mark.parametrize("mode", ["individual", "average"])
def test_every_product_of_a_scan_is_stored(spark, raw_scan, tmp_path, mode):
    root, s = str(tmp_path / "store"), small_scan(shot_mode=mode, isat_end=10)
    bad = raw_scan.where("shotnum < 6").withColumn("run", F.lit("short"))
    with pytest.raises(ValueError, match="shot count"):
        run_scan(spark, raw_scan.union(bad), s, root)
    found = run_scan(spark, raw_scan.union(bad), s, root, incomplete="skip")
    assert {r["run"]: r["violation"] for r in found.collect()} == {"r": None, "short": "shot count mismatch"}
    own = read_table(spark, root, "shots").collect()
    assert len(own) == 2 * 3 * 2 and {r["run"] for r in own} == {"r"}
    assert all(len(r["v_smooth_V"]) == 400 and r["isat_A"] is not None and r["dc_offset_A"] == 0 for r in own)
    assert all((r["te_eV"] is None and r["vg"] is None and not r["ok"]) == (mode == "average") for r in own)
    info = read_table(spark, root, "runs").first()
    assert info["acquired_traces"] == 6 and info["acquisition"]["dc_end"] == "15" and info["settings"]["iv_npts"] == "32"
    arrays = read_table(spark, root, "arrays")
    stored = {(r["product"], r["field"]): r for r in arrays.where("block = 0").collect()}
    assert stored["shot", "vg"]["shape"] == [1, 2, 3, 2, 32] and stored["curve", "didv"]["shape"] == [1, 2, 2, 32]
    if mode == "individual":
        curves = {(r["ix"], r["ishot"], r["iramp"]): r["vg"] for r in read_table(spark, root, "fits").collect()}
        for c in tensor_cells(arrays.where("product = 'shot' and field = 'vg'"), ["run"]).collect():
            at, k = divmod(c["index"], 32)
            assert c["value"] == curves[at // 6, at // 2 % 3, at % 2][k]
    else:
        empty = arrays.where("product = 'shot' and field in ('te_eV', 'vg')").select(F.explode("values").alias("v"))
        assert empty.where("v is not null").count() == 0
    # runs named before the first step are the only ones read
    assert run_scan(spark, raw_scan.union(bad), s, str(tmp_path / "one"), runs=["r"]).count() == 1


def test_completeness_reads_no_signals(spark, raw_scan, tmp_path):
    path = str(tmp_path / "in")
    first = raw_scan.where("shotnum <= 4")
    assert shots.ingest_shots(spark, first, path).collect() == []
    again = shots.ingest_shots(spark, raw_scan.where("shotnum >= 4"), path)
    assert {(r["channel"], r["shotnum"]) for r in again.collect()} == {(1, 4), (2, 4)}
    s, index = small_scan(), shots.read_shot_index(spark, path)
    assert shots.channel_check(index, s, 1).first()["violation"] == "shots stored twice"
    assert {r["n_samples"] for r in index.collect()} == {860}
    raw = shots.read_ingested(spark, path)
    from rampfield.plans.scan import checked_runs

    plan = checked_runs(raw, s)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "signal" not in plan
    bad = raw.withColumn("n_samples", F.when(F.col("shotnum") == 2, F.lit(7)).otherwise(F.col("n_samples"))).dropDuplicates(["channel", "shotnum"])
    assert checked_runs(bad, s).first()["violation"] == "time-length mismatch"


def test_positions_of_a_key_with_nearly_all_rows(spark):
    """Nine tenths of the rows in one key, over many range partitions."""
    from rampfield.operators.sweep import sweep_direction_of_samples

    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).select(
            F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("key"), F.hash("id").alias("t"), "id"
        )
        placed = position_in_group(rows, ["key"], ["t", "id"], "pos").collect()
        by_key = {}
        for r in placed:
            by_key.setdefault(r["key"], []).append((r["pos"], r["t"], r["id"]))
        assert len(by_key["hot"]) == 4500 and len(placed) == 5000
        for found in by_key.values():
            found.sort()
            assert [p for p, *_ in found] == list(range(len(found))) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        up = rows.withColumn("v", F.when(F.col("key") == "hot", F.col("id") / 100).otherwise(F.col("id") % 7))
        way = sweep_direction_of_samples(up, ["key"], ["id"], 0.1)
        # before it runs, the plan is printed once
        plan = way._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange" in line for line in plan.splitlines()) <= 6, plan
        assert {r["key"]: r["sweep_ok"] for r in way.collect()}["hot"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_diagnostic_shots_reach_the_scan(spark, raw_scan, tmp_path):
    raw_scan.write.parquet(str(tmp_path / "raw"))
    s = small_scan()
    chosen = shots.diagnostic_shots(spark.read.parquet(str(tmp_path / "raw")), s, 2)
    assert {r["shotnum"] for r in chosen.select("shotnum").collect()} == {1}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "shotnum" in plan.split("PushedFilters")[1].split("]")[0]
    for every in (1, 2, 3):
        ours = shots.paired_ramps(shots.diagnostic_shots(raw_scan, s, every), s).select("shotnum", "iramp").collect()
        whole = C.diagnostic_positions(shots.paired_ramps(raw_scan, s), every).select("shotnum", "iramp").collect()
        assert sorted(ours) == sorted(whole) and whole
    assert shots.diagnostic_shots(raw_scan, s, None).count() == shots.diagnostic_shots(raw_scan, s, 0).count() == 0


def test_a_run_is_not_scattered_over_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 5).cast("string").alias("run"), F.lit("x_line").alias("geometry"), "id")
    back = Staged(spark, str(tmp_path)).write(rows, "shots")
    assert back.count() == 4000 and back.select("id").distinct().count() == 4000
    for run in range(5):
        files = list(tmp_path.glob(f"shots/version=*/geometry=x_line/run={run}/*.parquet"))
        assert len(files) == 1


def test_wrong_length_fails_unless_its_run_is_left_out(spark, raw_scan, tmp_path):
    from pyspark.sql import functions as F

    s, root = small_scan(), str(tmp_path / "store")
    cut = F.when((F.col("channel") == 2) & (F.col("shotnum") == 2), F.slice("signal", 1, 859)).otherwise(F.col("signal"))
    bad = raw_scan.withColumns({"run": F.lit("cut"), "signal": cut})
    with pytest.raises(ValueError, match="run cut: time-length mismatch"):
        run_scan(spark, raw_scan.union(bad), s, root)
    with pytest.raises(Exception, match="Channel 2: time-length mismatch"):
        shots.paired_ramps(bad, s).count()
    # lengths come from the signals, or are stored with the shots
    shots.ingest_shots(spark, raw_scan.union(bad), str(tmp_path / "in"))
    for raw in (raw_scan.union(bad), shots.read_ingested(spark, str(tmp_path / "in"))):
        found = run_scan(spark, raw, s, root, incomplete="skip")
        assert {r["run"]: r["violation"] for r in found.collect()} == {"r": None, "cut": "time-length mismatch"}
        assert {r["run"] for r in read_table(spark, root, "shots").select("run").distinct().collect()} == {"r"}
