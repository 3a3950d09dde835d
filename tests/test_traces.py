"""Closed-form traces through the whole analysis."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampfield.functions.physics import electron_density_m3
from rampfield.functions.text import X, put
from rampfield.operators import background, quality, saturation, sweep
from rampfield.params import FitParams
from rampfield.plans.trace import analyze_traces, stages

E, ME = 1.602176634e-19, 9.1093837139e-31
AREA, TE, VP, NE, IION = 4e-6, 3.0, 10.0, 1e16, -2e-4
IES = E * NE * AREA * math.sqrt(E * TE / (2 * math.pi * ME))
BASE = FitParams(
    iv_npts=512, voltage_bin_width=0.05, vp_smoothing_width_V=1.0, probe_area=AREA,
    current_zero_calibrated=True,
)


def ideal(v, te=TE, iion=IION, growth=0.0):
    electron = np.exp(np.minimum((v - VP) / te, 0)) * (1 + growth * np.maximum(v - VP, 0))
    return IES * electron + iion * np.where(v <= VP, 1, np.exp(-np.maximum(v - VP, 0) / 0.2))


def make_traces():
    v = np.linspace(-20, 18, 1901)
    i = ideal(v)
    rng = np.random.default_rng(7)
    two = IES * (
        0.7 * np.exp(np.minimum((v - VP) / 1.5, 0)) + 0.3 * np.exp(np.minimum((v - VP) / 6.0, 0))
    ) + IION * np.where(v <= VP, 1, np.exp(-np.maximum(v - VP, 0) / 0.2))
    up_down = np.concatenate([v, v[::-1]])
    gap = (v < 8) | (v > 12)
    holed = i.copy()
    holed[100] = np.nan
    return {
        "ideal": (v, i),
        "backwards": (v[::-1], i[::-1]),
        "holed": (v, holed),
        "expanding": (v, ideal(v, growth=0.06)),
        "reversed_polarity": (v, -i),
        "up_down": (up_down, np.concatenate([i, i[::-1]])),
        "high_only": (v[v >= -2], i[v >= -2]),
        "gap": (v[gap], i[gap]),
        "no_crossing": (v, i + 1e-3),
        "no_knee": (v[v < 9.9], i[v < 9.9]),
        "noisy": (v, i + rng.normal(0, 5e-5, v.size)),
        "faint_ion": (v, ideal(v, iion=-2e-5) + rng.normal(0, 2e-4, v.size)),
        "two_temperature": (v, two),
        "short": (v[:5], i[:5]),
    }


@pytest.fixture(scope="module")
def traces(spark):
    rows = [(n, [float(x) for x in v], [float(x) for x in i]) for n, (v, i) in make_traces().items()]
    return spark.createDataFrame(rows, "trace string, v array<double>, i array<double>").repartition(4)


def run(traces, params):
    return {r["trace"]: r for r in analyze_traces(traces, params, ["trace"]).collect()}


@pytest.fixture(scope="module")
def fits(traces):
    return run(traces, BASE)


@pytest.fixture(scope="module")
def bounded(traces):
    return run(traces, BASE.with_(te_region_method="bounded"))


def test_known_parameters_are_recovered(fits):
    r = fits["ideal"]
    assert r["ok"] and r["warnings"] == []
    assert r["te_eV"] == pytest.approx(TE, rel=0.03)
    assert r["vp_V"] == pytest.approx(VP, abs=0.2)
    assert r["vf_V"] == pytest.approx(VP + TE * math.log(-IION / IES), abs=0.1)
    assert r["ies_A"] == pytest.approx(IES, rel=0.03)
    assert r["n_e_m3"] == pytest.approx(NE, rel=0.05)


def test_sweep_direction_and_missing_samples_do_not_matter(fits):
    for name in ("te_eV", "vp_V", "vf_V", "ies_A"):
        assert fits["backwards"][name] == pytest.approx(fits["ideal"][name], rel=1e-9)
        assert fits["holed"][name] == pytest.approx(fits["ideal"][name], rel=1e-3)


@pytest.mark.parametrize(
    "trace, gate, text",
    [
        ("reversed_polarity", 4, quality.W_CROSSING),
        ("up_down", 1, quality.W_DIRECTION),
        ("no_crossing", 4, quality.W_CROSSING),
        ("no_knee", 5, quality.W_PEAK),
        ("short", 1, quality.W_DIRECTION),
    ],
)
def test_first_failing_gate(fits, trace, gate, text):
    assert not fits[trace]["ok"]
    assert fits[trace]["gate"] == gate
    assert fits[trace]["warnings"][-1] == text


def test_rejected_traces_keep_earlier_estimates(fits):
    gap = fits["gap"]
    assert not gap["ok"] and gap["te_eV"] is None
    faint = fits["faint_ion"]
    assert not faint["ok"] and faint["gate"] in (7, 8, 9)
    assert fits["up_down"]["vf_V"] is None


def test_noisy_trace_is_accepted(bounded):
    assert bounded["noisy"]["te_eV"] == pytest.approx(TE, rel=0.1)


def test_two_temperatures_are_told_apart(fits, bounded, traces):
    assert bounded["two_temperature"]["ok"]
    assert not fits["two_temperature"]["ok"] or fits["two_temperature"]["te_fit_curvature_log"] <= 0.05
    strict = run(
        traces.where("trace = 'two_temperature'"),
        BASE.with_(te_region_method="bounded", enforce_ideal_model_checks=True),
    )
    assert not strict["two_temperature"]["ok"]


def test_expanding_sheath_depends_on_the_saturation_method(traces, fits):
    at_vp = run(traces.where("trace in ('expanding', 'ideal')"), BASE.with_(ies_method="at_vp"))
    assert fits["expanding"]["ies_A"] > 1.15 * at_vp["expanding"]["ies_A"]
    assert at_vp["ideal"]["ies_A"] == pytest.approx(IES, rel=0.15)


def test_uncalibrated_zero_stops_after_the_curve(traces):
    r = run(traces.where("trace = 'ideal'"), BASE.with_(current_zero_calibrated=False))["ideal"]
    assert r["gate"] == 3 and r["vf_V"] is None and r["warnings"] == [quality.W_ZERO]


def test_missing_area_warns_without_rejecting(traces):
    r = run(traces.where("trace = 'ideal'"), BASE.with_(probe_area=None))["ideal"]
    assert r["ok"] and r["n_e_m3"] is None and r["warnings"] == [quality.W_AREA]


def test_partitioning_leaves_results_unchanged(traces, fits):
    again = run(traces.where("trace = 'noisy'").repartition(3), BASE)["noisy"]
    assert again == fits["noisy"]


def test_density_value(spark):
    row = put(
        spark.range(1), {
            "n": electron_density_m3(X.lit(1.0), X.lit(3.0), 4.0, current_unit="mA", area_unit="mm2"),
            "bad": electron_density_m3(X.lit(-1.0), X.lit(3.0), 4e-6),
            "flipped": electron_density_m3(X.lit(-1e-3), X.lit(3.0), 4e-6, use_abs=True),
        },
    ).first()
    assert row["n"] == pytest.approx(5.384535228598626e15, rel=1e-9)
    assert row["bad"] is None and row["flipped"] == pytest.approx(row["n"])


def test_traces_are_binned_in_batches(spark):
    def bins(v, i, width):
        keep = [(a, b) for a, b in zip(v, i) if a is not None and b is not None and np.isfinite(a) and np.isfinite(b)]
        low = min((a for a, _ in keep), default=0)
        cells = {}
        for a, b in sorted(keep):
            cells.setdefault(math.floor((a - low) / width), []).append((a, b))
        out = [np.mean(cells[k], 0) for k in sorted(cells)]
        return out if len(out) >= 2 else None

    rng = np.random.default_rng(5)
    rows = [(k, rng.uniform(0, 3, 5 + 9 * k).tolist(), rng.normal(size=5 + 9 * k).tolist()) for k in range(30)]
    rows += [
        (100, [], []), (101, [1.0], [2.0]), (102, [1.0, None, 2.0, float("nan"), 2.5], [1.0, 5.0, 2.0, 3.0, None]),
        (103, [None] * 4, [1.0] * 4), (104, [float(k) for k in range(50)], [1.0] * 50), (105, [1.0] * 50, [1.0] * 50),
    ]
    df = spark.createDataFrame(rows, "k int, v array<double>, i array<double>")
    done = sweep.bin_traces(sweep.sweep_direction(df, 0.1), 0.1)
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    for r in done.collect():
        expected = bins(r.v, r.i, 0.1)
        if expected is None:
            assert r.vb is None and r.ib is None
        else:
            assert np.column_stack([r.vb, r.ib]) == pytest.approx(np.array(expected), abs=1e-12)
        assert r.sweep_ok == (r.k == 104)


def is_straight(v, y, least_r2=0.95):
    """The rule of the search on the bins of one candidate."""
    x = (v - v.mean()) / (v[-1] - v[0])
    slope, level = np.polyfit(x, y, 1)
    residual = y - level - slope * x
    blocks = [abs(b.mean()) for b in np.array_split(residual, max(1, min(8, len(v) // 3)))]
    error = math.sqrt(residual @ residual / (len(v) - 2) / (x @ x))
    return (
        slope >= 1 and 1 - residual @ residual / ((y - y.mean()) @ (y - y.mean())) >= least_r2 and error <= 0.3 * slope
        and abs(np.polyfit(x, y, 2)[0]) <= 0.05 and max(blocks) <= 0.02
    )


def searched(v, y, intervals, least=8):
    """Start, stop and number of judged candidates of one trace, a candidate at a time."""

    def edges(lo, hi, pieces):
        return sorted({hi if j == pieces else math.floor(j * ((hi - lo) / pieces) + lo) for j in range(pieces + 1)})

    def first(candidates):
        for a, b in sorted(candidates, key=lambda c: (v[c[0]] - v[c[1] - 1], *c)):
            judged.add((a, b))
            if is_straight(v[a:b], y[a:b]):
                return a, b
        return None

    judged = set()
    home = {(a, b): x for x in intervals if x[1] - x[0] >= least for a in edges(*x, min(32, x[1] - x[0])) for b in edges(*x, min(32, x[1] - x[0])) if b - a >= least}
    best = first(home)
    if best is None:
        return None, None, len(judged)
    low, high = home[best]
    step = max(1, math.ceil((high - low) / 32))
    while True:
        a0, b0 = best
        finer = {
            (a, b) for a in edges(max(low, a0 - step), min(b0 - least, a0 + step), 8) for b in edges(max(a0 + least, b0 - step), min(high, b0 + step), 8)
            if b - a >= least and v[b - 1] - v[a] >= v[b0 - 1] - v[a0]
        }
        best = first(finer) or best
        if step == 1:
            return *best, len(judged)
        step = max(1, step // 4)


def test_straight_intervals_are_searched_in_batches():
    import pyarrow as pa

    from rampfield.operators.straight_search import broadest_straight

    rng, rows = np.random.default_rng(8), []
    for k in range(400):
        n = int(rng.integers(9, 260))
        v = np.cumsum(rng.uniform(0.08, 0.12, n))
        y = v / rng.uniform(0.8, 4) + rng.uniform(0, 0.4) * np.sin(v * rng.uniform(0.1, 1)) + rng.normal(0, 10 ** rng.uniform(-4, -1), n)
        cut = int(rng.integers(1, n))
        intervals = [[], [(0, n)], [(0, cut)], [(0, cut), (min(cut + 1, n - 1), n)]][min(3, k % 8)]
        rows.append((v, y, intervals))
    lists = lambda values: pa.array([list(x) for x in values])
    ion = -1e-4
    found = broadest_straight(
        lists(v for v, _, _ in rows), lists(np.exp(y) + ion for _, y, _ in rows),
        pa.array([[a for a, _ in x] for _, _, x in rows], pa.list_(pa.int32())), pa.array([[b for _, b in x] for _, _, x in rows], pa.list_(pa.int32())),
        pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int32()), pa.array([ion] * len(rows)), 8, 0.95,
    ).to_pylist()
    expected = [searched(v, y, x) for v, y, x in rows]
    assert [(r["start"], r["stop"], r["candidates"]) for r in found] == expected
    assert 50 < sum(a is not None for a, _, _ in expected) < 350


def test_shared_steps_are_done_once(spark):
    from rampfield.plans.trace import configurations, fits_of

    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    v, i = make_traces()["ideal"]
    kinds = "trace int, v array<double>, i array<double>"
    some = spark.createDataFrame([(k, v.tolist(), i.tolist()) for k in range(6)], kinds).mapInArrow(touch, kinds)
    both = configurations(some, {"wide": BASE, "bounded": BASE.with_(te_region_method="bounded")})
    for done in both.values():
        # only what later steps read is stored
        assert not {"v", "i", "va", "ia", "vg", "ig", "didv"} & set(done.columns)
        assert [r["ok"] for r in fits_of(done, BASE, ["trace"]).collect()] == [True] * 6
    assert seen.value == 6


def test_nested_windows_are_found_in_batches():
    import pyarrow as pa

    from rampfield.operators.window_fit import nested_spans

    rng, widths = np.random.default_rng(4), (6.0, 9.0, 12.0, 30.0)
    curves = [np.cumsum(rng.uniform(0.05, 0.6, int(rng.integers(2, 200)))) for _ in range(60)]
    tops = [None if k % 9 == 0 else float(rng.uniform(0, c[-1] + 2)) for k, c in enumerate(curves)]
    found = nested_spans(pa.array([*map(list, curves), None], pa.list_(pa.float64())), pa.array([*tops, 5.0]), widths, 8).to_pylist()
    for v, top, spans in zip(curves, tops, found, strict=False):
        expected = []
        for w in widths if top is not None else ():
            inside = np.flatnonzero((v >= top - w) & (v <= top))
            if v[0] <= top - w + np.median(np.diff(v)) and len(inside) >= 8:
                expected.append({"width": w, "start": inside[0], "n": len(inside)})
        assert spans == expected
    assert found[-1] == [] and sum(map(len, found)) > 60


def test_log_checks_of_a_batch_of_windows():
    import pyarrow as pa

    from rampfield.operators.window_fit import log_checks

    v, noise = np.linspace(-9, 0, 90), 1e-7
    line, e = np.full(90, -1e-4), 1e-3 * np.exp(v / 2)
    bent, negative = e * np.where(v > -2, 1.2, 1.0), np.where(v > -0.05, -e, e)
    lists = lambda *values: pa.array([None if x is None else list(x) for x in values], pa.list_(pa.float64()))
    signal = [e, bent, negative, e, e]
    got = log_checks(
        lists(*[v] * 5), lists(*[line + s for s in signal]), lists(e, e, e, e, None), lists(line, line, line, line, None),
        pa.array([1e-3] * 4 + [None]), pa.array([2.0] * 4 + [None]), pa.array([noise, noise, noise, None, noise]), 8, 0.03,
    ).to_pylist()
    resolved = v[e >= 0.03 * 1e-3]
    assert [r["ok"] for r in got] == [True, False, False, False, False]
    assert [(r["v0"], r["v1"]) for r in got] == [(resolved[0], resolved[-1])] * 2 + [(None, None)] * 3


def test_equal_voltages_are_ordered_by_current():
    from rampfield.operators.sweep_batches import _by_voltage

    rng = np.random.default_rng(2)
    row = np.repeat([0, 2, 3], [40, 1, 60])
    vs, cs = rng.integers(0, 30, len(row)).astype(float), rng.normal(size=len(row))
    assert (_by_voltage(row, vs, cs) == np.lexsort((cs, vs, row))).all()


def test_accuracy_reads_the_fits_once(spark):
    from rampfield.operators.accuracy import error_table

    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(g, True, float(k), float(-k)) for g in (1, 2) for k in range(11)]
    kinds = "family int, ok boolean, te_error_percent double, ne_error_percent double"
    table = error_table(spark.createDataFrame(rows, kinds).mapInArrow(touch, kinds), ["family"]).collect()
    assert seen.value == len(rows)
    assert {(r.family, r.cases, r.accepted, r.te_error_percent_p50, r.ne_error_percent_p50) for r in table} == {(1, 11, 11, 5.0, -5.0), (2, 11, 11, 5.0, -5.0)}


def test_effective_sample_count_against_numpy(spark):
    rng = np.random.default_rng(3)
    cases = [rng.normal(size=80), np.cumsum(rng.normal(size=120)), np.ones(9), np.array([1.0])]

    def direct(a):
        c = a - a.mean()
        if len(a) < 2 or c @ c <= 0:
            return float(len(a))
        rho = np.correlate(c, c, "full")[len(a):] / (c @ c)
        stop = np.flatnonzero(rho <= 0)
        rho = rho[: stop[0]] if stop.size else rho
        return float(np.clip(len(a) / (1 + 2 * rho.sum()), 1, len(a)))

    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(cases)], "k int, a array<double>")
    got = {r["k"]: r["n"] for r in put(df, "n", saturation.effective_sample_count(X.col("a"))).collect()}
    for k, c in enumerate(cases):
        assert got[k] == pytest.approx(direct(c), rel=1e-9)


def test_two_shots_are_pooled_in_voltage_bins(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 1.0, 2.0], [0.0, 2.0, 4.0]), (0, [0.1, 1.1, 2.1], [2.0, 4.0, 6.0])],
        "place int, v array<double>, i array<double>",
    )
    row = sweep.pool_shots(df, ["place"], 0.5).first()
    assert row["v"] == pytest.approx([0.05, 1.05, 2.05])
    assert row["i"] == pytest.approx([1.0, 3.0, 5.0])


def test_length_mismatch_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "v array<double>, i array<double>")
    with pytest.raises(Exception, match="same length"):
        sweep.bin_traces(df, 0.1).collect()


def test_exponential_background_temperatures(spark):
    rows = []
    for t in (1.0, 3.0, 12.0, 20.0):
        v = np.linspace(10 - 5 * t, 10, 301)
        x = v - v[-1]
        rows.append((t, v.tolist(), (0.8 * np.exp(x / t) + 0.1 + 0.001 * x).tolist()))
    df = spark.createDataFrame(rows, "t double, wv array<double>, wi array<double>")
    for r in background.fit_windows(df, 0.1, 300.0).collect():
        assert r["bg"]["valid"]
        assert r["bg"]["te_eV"] == pytest.approx(r["t"], rel=1e-6)
        assert r["bg"]["amplitude_A"] == pytest.approx(0.8, rel=1e-6)


def test_windows_are_fitted_in_batches(spark):
    rows = []
    for k in range(60):
        t, size = 1.0 + 0.1 * k, 40 + 7 * k
        x = np.linspace(-6 * t, 0, size)
        rows.append((k, t, (10 + x).tolist(), (2e-3 * (0.8 * np.exp(x / t) + 0.1 + 0.002 * x)).tolist()))
    level = [1.0] * 20
    rows += [
        (100, None, None, None), (101, None, level[:3], level[:3]), (102, None, [float(k) for k in range(20)], level),
        (103, None, level, [float(k) for k in range(20)]), (104, None, [None, *level[:9], *level[:10]], [float(k * k) for k in range(20)]),
    ]
    df = spark.createDataFrame(rows, "k int, t double, wv array<double>, wi array<double>").repartition(2, "k")
    fits = background.fit_windows(df, 0.1, 300.0)
    assert fits._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    for r in fits.collect():
        if r.t is None:
            assert r.bg is None
            continue
        assert r.bg.valid and r.bg.te_eV == pytest.approx(r.t, rel=1e-6)
        x = np.array(r.wv) - r.wv[-1]
        assert r.bg.exponential_A == pytest.approx(1.6e-3 * np.exp(x / r.t), rel=1e-5)
        assert r.bg.background_A == pytest.approx(2e-4 + 4e-6 * x, rel=1e-4)
        assert r.bg.fitted_A == pytest.approx(r.wi, rel=1e-6)


def test_parameters_are_checked():
    with pytest.raises(ValueError, match="Unknown"):
        FitParams.from_mapping({"nope": 1})
    for bad in (
        {"iv_npts": 3}, {"voltage_bin_width": 0}, {"te_min_r2": 2}, {"te_min_eV": 40},
        {"ies_method": "x"}, {"probe_area": -1}, {"current_zero_calibrated": 1}, {"vp_smoothing": "x"},
    ):
        with pytest.raises(ValueError):
            FitParams(**bad)


def test_windows_of_every_trace(spark, traces):
    done = stages(traces, BASE).withColumn("ion", F.when(F.col("trace") != "ideal", F.col("ion")))
    rows = background.bulk_windows(done, ["trace"], BASE).select(
        "trace", "width_V", "bg.te_eV", "residual_pass", "bulk_log_pass", "stable", "is_bulk"
    ).collect()
    known = {r.trace: r for r in done.select("trace", "vp_derivative_V", "vf_V", "ion.current", "ion.noise").collect()}
    assert {r.trace for r in rows} == set(known)
    assert all(r.width_V is None for r in rows if known[r.trace].vp_derivative_V is None)
    unjudged = [r for r in rows if known[r.trace].noise is None]
    left_out = {n for n, k in known.items() if k.vf_V is None or k.current is None}
    assert any(r.trace in left_out and r.te_eV is not None for r in rows)
    assert not any(r.residual_pass or r.bulk_log_pass or r.stable or r.is_bulk for r in unjudged)
    assert all(sum(r.trace == n and r.width_V is None for r in rows) <= 1 for n in known)
