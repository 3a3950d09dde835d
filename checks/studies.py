"""Background fits, nested windows, hot-tail screen and accuracy reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rampfield.functions.text import X, put
from rampfield.operators import accuracy as V
from rampfield.operators import background as H
from rampfield.params import BULK_WINDOW_WIDTHS_V
from rampfield.plans import trace as plan

from .common import AREA_M2, MODEL, R, Registry, model_parameters, model_sql, model_traces, rounded
from .traces import STAGES, TO_ELIG, TO_ION, TO_IES, chain, fit_sql

reg = Registry()
BOUNDED = MODEL.with_(te_region_method="bounded")
# the bounds of the analysis hold for its background windows too
LOW, HIGH = BOUNDED.te_min_eV, BOUNDED.te_max_eV
ROUNDS = 14


def background_sql(windows: str) -> str:
    """Stages that fit every window of ``windows`` (trace, width, x, y scaled) by narrowing alone."""
    step = (math.log(HIGH) - math.log(LOW)) / 48
    key = "trace, width"
    # Residuals are summed point by point: the minimum of a difference of moments
    # would be blurred by cancellation.
    score = f"""SELECT {key}, lt, sum(pow(a * exp(x * exp(-lt)) + d * (x - mx) + my - a * me - y, 2)) AS rss FROM (%(points)s) JOIN (
       SELECT *, (cxy - a * cex) / cxx AS d FROM (SELECT *, (cey - cex * cxy / cxx) / (cee - cex * cex / cxx) AS a FROM (
       SELECT {key}, lt, avg(x) AS mx, avg(y) AS my, avg(exp(x * exp(-lt))) AS me, var_pop(x) AS cxx, covar_pop(x, y) AS cxy, var_pop(exp(x * exp(-lt))) AS cee,
              covar_pop(exp(x * exp(-lt)), x) AS cex, covar_pop(exp(x * exp(-lt)), y) AS cey FROM (%(points)s) GROUP BY {key}, lt))) USING ({key}, lt) GROUP BY {key}, lt"""
    parts = [
        f"""t0 AS MATERIALIZED (SELECT {key}, arg_min(lt, rss) AS lt, {step!r}::DOUBLE AS h FROM ({score % {"points": f"SELECT *, ln({LOW}) + {step!r}::DOUBLE * u AS lt FROM {windows}, range(49) t(u)"}}) GROUP BY {key})"""
    ]
    for r in range(1, ROUNDS + 1):
        points = f"""SELECT w.trace, w.width, w.x, w.y, lt + (u - 4) * h / 4 AS lt FROM {windows} w JOIN t{r - 1} USING ({key}), range(9) t(u)"""
        parts.append(
            f"""t{r} AS MATERIALIZED (SELECT s.trace, s.width, arg_min(s.lt, rss) AS lt, any_value(p.h) / 4 AS h FROM ({score % {"points": points}}) s JOIN t{r - 1} p USING ({key}) GROUP BY s.trace, s.width)"""
        )
    parts.append(
        f"""
wz AS MATERIALIZED (SELECT w.*, lt, exp(x * exp(-lt)) AS e FROM {windows} w JOIN t{ROUNDS} USING ({key})),
m0 AS (SELECT {key}, any_value(lt) AS lt, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(e) AS me, var_pop(x) AS cxx, covar_pop(x, y) AS cxy, var_pop(e) AS cee,
  covar_pop(e, x) AS cex, covar_pop(e, y) AS cey FROM wz GROUP BY {key}),
m1 AS (SELECT *, (cey - cex * cxy / cxx) / (cee - cex * cex / cxx) AS a FROM m0),
m2 AS (SELECT *, (cxy - a * cex) / cxx AS d FROM m1),
m3 AS MATERIALIZED (SELECT *, my - a * me - d * mx AS c FROM m2),
r0 AS MATERIALIZED (SELECT w.*, m.a, m.c, m.d, a * w.e + c + d * w.x - w.y AS res, -a * w.e * w.x * exp(-w.lt) AS g FROM wz w JOIN m3 m USING ({key})),
gm AS (SELECT {key}, count(*) AS n, avg(g) AS mg, sum(res * res) AS ss, covar_pop(g, x) * count(*) AS sgx, covar_pop(g, e) * count(*) AS sge, var_pop(g) * count(*) AS sgg,
  var_pop(x) * count(*) AS sxx, var_pop(e) * count(*) AS see, covar_pop(e, x) * count(*) AS sex, var_pop(y) * count(*) AS syy, any_value(scale) AS scale,
  max(x) - min(x) AS span, any_value(top) AS top, avg(x) AS mx, avg(e) AS me FROM r0 GROUP BY {key}),
bg AS MATERIALIZED (SELECT g.trace, g.width, exp(lt) AS te, a * scale AS amp, c * scale AS level, d * scale AS slope, sqrt(ss / g.n) * scale AS rmse, 1 - ss / syy AS r2,
   see - sex * sex / sxx AS pe, sgg - sgx * sgx / sxx - pow(sge - sgx * sex / sxx, 2) / (see - sex * sex / sxx) AS pg,
   ss / (g.n - 4) AS var, g.n, g.span, g.top, least(lt - ln({LOW}), ln({HIGH}) - lt) < 0.01 AS edge, a,
   sqrt(ss / (g.n - 4) / (sgg - sgx * sgx / sxx - pow(sge - sgx * sex / sxx, 2) / (see - sex * sex / sxx))) AS rel,
   sqrt(ss / (g.n - 4) * (1.0 / g.n + g.mx * g.mx / sxx + pow(g.me - sex / sxx * g.mx, 2) / (see - sex * sex / sxx)
      + pow(mg - sgx / sxx * g.mx - (sge - sgx * sex / sxx) / (see - sex * sex / sxx) * (g.me - sex / sxx * g.mx), 2)
        / (sgg - sgx * sgx / sxx - pow(sge - sgx * sex / sxx, 2) / (see - sex * sex / sxx)))) * scale AS sigma
   FROM gm g JOIN m3 USING ({key})),
bgv AS MATERIALIZED (SELECT *, coalesce(amp > 0 AND NOT edge AND span / te >= 1 AND rel <= 0.3, false) AS valid FROM bg)"""
    )
    return ",".join(parts)


def halo_chain(select: str, names: tuple[str, ...], *extra: str) -> str:
    pieces = [{"raw": model_sql(halo=True)}.get(n) or (fit_sql("widest", "bounded") if n == "bounded" else STAGES[n]) for n in names]
    return "WITH " + ",".join([*pieces, *extra]) + "\n" + select


SCALED = """
{out} AS MATERIALIZED (SELECT b.trace, b.width, b.j, b.vb - t.top AS x, b.ib / t.sc AS y, t.sc AS scale, t.top FROM {src} b JOIN
   (SELECT trace, width, max(vb) AS top, max(ib) - min(ib) AS sc FROM {src} GROUP BY trace, width) t USING (trace, width))"""


# --- T25 -----------------------------------------------------------------------------

ONE_WINDOW = """
one AS MATERIALIZED (SELECT b.trace, 12.0::DOUBLE AS width, b.j, b.vb, b.ib FROM bins b JOIN vp USING (trace) WHERE b.vb >= vp - 0.2 - 12 AND b.vb <= vp - 0.2)"""


@reg.add(
    "T25_exponential_background",
    halo_chain(
        f"""SELECT trace, {R('te', 4)} AS te_eV, {R('amp * 1e3', 4)} AS amplitude_mA, {R('level * 1e6', 2)} AS level_uA, {R('slope * 1e6', 2)} AS slope_uA_per_V,
        {R('rmse * 1e6', 4)} AS rmse_uA, {R('rel', 6)} AS rel, {R('sigma * 1e6', 4)} AS level_error_uA, valid FROM bgv""",
        ("raw", "bins", "shape", "analysis", "savgol", "vf0", "vp"),
        ONE_WINDOW, SCALED.format(out="w", src="one"), background_sql("w")),
)
def t25(spark, sf):
    found = plan.potentials(model_traces(spark, sf, halo=True), MODEL).where("vp_derivative_V is not null")
    kept = put(
        found, "_w",
        X.filter(
            X.zip_with("vb", "ib", lambda v, i: X.struct(v.alias("v"), i.alias("i"))),
            lambda p: p.v.between(X.col("vp_derivative_V") - 0.2 - 12, X.col("vp_derivative_V") - 0.2),
        ),
    )
    windows = kept.select("trace", F.col("_w.v").alias("wv"), F.col("_w.i").alias("wi"))
    b = lambda n: F.col(f"bg.{n}")
    return H.fit_windows(windows, LOW, HIGH).select(
        "trace", rounded(b("te_eV"), 4).alias("te_eV"), rounded(b("amplitude_A") * 1e3, 4).alias("amplitude_mA"),
        rounded(b("background_at_vmax_A") * 1e6, 2).alias("level_uA"),
        rounded(b("background_slope_A_per_V") * 1e6, 2).alias("slope_uA_per_V"), rounded(b("rmse_A") * 1e6, 4).alias("rmse_uA"),
        rounded(b("te_relative_uncertainty"), 6).alias("rel"),
        rounded(b("background_at_vmax_uncertainty_A") * 1e6, 4).alias("level_error_uA"), b("valid").alias("valid"),
    )


# --- T26, T27 ------------------------------------------------------------------------

_WIDTHS = ", ".join(f"({w}.0::DOUBLE)" for w in BULK_WINDOW_WIDTHS_V)
NESTED = f"""
wid AS (SELECT trace, width, vp - 0.2 AS up FROM vp JOIN vf USING (trace) JOIN ion USING (trace) JOIN shape USING (trace), (VALUES {_WIDTHS}) t(width)
        WHERE va0 <= vp - 0.2 - width + dv),
nest0 AS MATERIALIZED (SELECT b.trace, width, b.j, b.vb, b.ib FROM bins b JOIN wid USING (trace) WHERE b.vb >= up - width AND b.vb <= up),
nest AS (SELECT * FROM nest0 WHERE (trace, width) IN (SELECT (trace, width) FROM nest0 GROUP BY trace, width HAVING count(*) >= 8))"""
CHECKS = """
sup AS MATERIALIZED (SELECT r.trace, r.width, r.j, r.x + r.top AS v, r.a * r.e * r.scale AS mod, (r.y - r.c - r.d * r.x) * r.scale AS cor, i.noise FROM r0 r JOIN ion i USING (trace)
   JOIN bg USING (trace, width) WHERE r.a * r.e * r.scale >= greatest(5 * i.noise, 0.03 * bg.amp)),
sn AS (SELECT trace, width, count(*) AS n, bool_and(cor > 0) AS pos, min(v) AS v0, max(v) AS v1 FROM sup GROUP BY trace, width),
so AS (SELECT s.*, n, least(8, n // 3) AS parts, row_number() OVER (PARTITION BY s.trace, s.width ORDER BY s.j) - 1 AS o FROM sup s JOIN sn USING (trace, width) WHERE n >= 8 AND pos),
sb AS (SELECT trace, width, CASE WHEN o < (n % parts) * (n // parts + 1) THEN o // (n // parts + 1) ELSE n % parts + (o - (n % parts) * (n // parts + 1)) // (n // parts) END AS blk,
   abs(avg(ln(cor / mod))) <= 0.02 + 3 * any_value(noise) * sqrt(sum(1 / (mod * mod))) / count(*) AS ok FROM so GROUP BY ALL),
sc2 AS (SELECT trace, width, bool_and(ok) AS ok FROM sb GROUP BY trace, width),
win AS MATERIALIZED (SELECT b.*, i.noise, b.rmse <= greatest(1.5 * i.noise, 0.005 * b.amp) AS rp, coalesce(s.ok AND (n.v1 - n.v0) / b.te >= 1, false) AS lp,
   CASE WHEN s.ok IS NOT NULL THEN n.v0 END AS sv0, CASE WHEN s.ok IS NOT NULL THEN n.v1 END AS sv1
   FROM bgv b JOIN ion i USING (trace) LEFT JOIN sc2 s USING (trace, width) LEFT JOIN sn n USING (trace, width)),
stb AS MATERIALIZED (SELECT *, coalesce(valid AND rp AND lp AND lag(valid AND rp AND lp, 1) OVER t AND lag(valid AND rp AND lp, 2) OVER t
   AND greatest(te, lag(te, 1) OVER t, lag(te, 2) OVER t) / least(te, lag(te, 1) OVER t, lag(te, 2) OVER t) < 1.05, false) AS stable FROM win
   WINDOW t AS (PARTITION BY trace ORDER BY width)),
bulk AS MATERIALIZED (SELECT * FROM stb WHERE stable QUALIFY row_number() OVER (PARTITION BY trace ORDER BY width DESC) = 1)"""
TO_BULK = (NESTED, SCALED.format(out="w", src="nest"), background_sql("w"), CHECKS.replace("win AS", "wins AS").replace("FROM win\n", "FROM wins\n"))


@reg.add(
    "T26_bulk_windows",
    halo_chain(
        f"""SELECT s.trace, s.width AS width_V, {R('s.te', 3)} AS te_eV, s.valid, s.rp AS residual_pass, s.lp AS bulk_log_pass, s.stable,
        coalesce(s.width = b.width, false) AS is_bulk, {R('s.sv0', 5)} AS signal_vstart_V FROM stb s LEFT JOIN bulk b USING (trace)""",
        TO_ION, *TO_BULK),
)
def t26(spark, sf):
    done = plan.stages(model_traces(spark, sf, halo=True), BOUNDED)
    bulk = H.bulk_windows(done, ["trace"], BOUNDED)
    return bulk.select(
        "trace", "width_V", rounded("bg.te_eV", 3).alias("te_eV"), F.col("bg.valid").alias("valid"), "residual_pass", "bulk_log_pass",
        "stable", "is_bulk", rounded("bulk_signal_vstart_V", 5).alias("signal_vstart_V"),
    )


@reg.add(
    "T27_hot_tail_screen",
    halo_chain(
        f"""SELECT m.trace, CASE WHEN b.trace IS NULL OR ies IS NULL THEN 'inconclusive' WHEN level - cur > 5 * sqrt(sigma * sigma + err * err)
            AND (level - cur) / ies >= 0.01 THEN 'possible' ELSE 'not_resolved' END AS status,
        {R('CASE WHEN ies IS NOT NULL THEN (level - cur) * 1e6 END', 2)} AS excess_uA, {R('CASE WHEN ies IS NOT NULL THEN sqrt(sigma * sigma + err * err) * 1e6 END', 3)} AS error_uA,
        {R('CASE WHEN ies IS NOT NULL THEN b.te END', 3)} AS bulk_te_eV FROM model m LEFT JOIN bulk b USING (trace) LEFT JOIN ion i ON i.trace = m.trace LEFT JOIN ies s ON s.trace = m.trace""",
        TO_IES, *TO_BULK),
)
def t27(spark, sf):
    traces = model_traces(spark, sf, halo=True)
    done = plan.configurations(traces, {"bounded": BOUNDED})["bounded"]
    bulk = H.bulk_windows(done, ["trace"], BOUNDED)
    fits = plan.fits_of(done, BOUNDED, ["trace"])
    return H.hot_tail_screen(fits, bulk, ["trace"], 0.01).select(
        "trace", "status", rounded(F.col("excess_current_A") * 1e6, 2).alias("excess_uA"),
        rounded(F.col("excess_current_uncertainty_A") * 1e6, 3).alias("error_uA"), rounded("bulk_candidate_te_eV", 3).alias("bulk_te_eV"),
    )


# --- V1, V2 --------------------------------------------------------------------------

NE = "{i} / (1.602176634e-19 * 4e-6 * sqrt({t} * 1.602176634e-19 / (2 * pi() * 9.1093837139e-31)))"


@reg.add(
    "V1_accuracy_report",
    chain(
        f"""SELECT family, count(*) AS cases, count(*) FILTER (ok) AS accepted,
    {R('quantile_cont(te_err, 0.05) FILTER (ok)', 5)} AS te_p05, {R('quantile_cont(te_err, 0.5) FILTER (ok)', 5)} AS te_p50, {R('quantile_cont(te_err, 0.95) FILTER (ok)', 5)} AS te_p95,
    {R('quantile_cont(ne_err, 0.5) FILTER (ok)', 5)} AS ne_p50 FROM (
    SELECT m.trace % 7 AS family, coalesce(b.reason IS NULL AND b.n >= 8, false) AS ok, 100 * (b.te / true_te - 1) AS te_err,
      100 * (({NE.format(i='ies', t='b.te')}) / ({NE.format(i='true_ies', t='true_te')}) - 1) AS ne_err
    FROM model m LEFT JOIN bounded b USING (trace) LEFT JOIN ies USING (trace)) GROUP BY family""",
        *TO_ELIG, "bounded"),
)
def v1(spark, sf):
    from rampfield.functions.physics import electron_density_m3

    fits = plan.analyze_traces(model_traces(spark, sf), BOUNDED, ["trace"])
    p = put(
        model_parameters(spark, sf), "true_ne_m3", electron_density_m3(X.col("true_ies"), X.col("true_te"), AREA_M2)
    ).select("trace", F.col("true_te").alias("true_te_eV"), "true_ne_m3")
    errors = V.percent_errors(fits, p, ["trace"]).withColumn("family", F.col("trace") % 7)
    return V.error_table(errors, ["family"]).select(
        "family", "cases", "accepted", rounded("te_error_percent_p05", 5).alias("te_p05"),
        rounded("te_error_percent_p50", 5).alias("te_p50"), rounded("te_error_percent_p95", 5).alias("te_p95"),
        rounded("ne_error_percent_p50", 5).alias("ne_p50"),
    )


@reg.add(
    "V2_beam_comparison",
    halo_chain(
        f"""SELECT m.trace, {R('bd.te', 6)} AS bounded_te_eV, b.trace IS NOT NULL AS bulk_candidate_found, {R('b.te', 3)} AS bulk_te_eV, b.width AS bulk_width_V,
        {R('(level - cur) * 1e6', 2)} AS excess_uA, coalesce(level - cur > 5 * sqrt(sigma * sigma + err * err), false) AS excess_5sigma
        FROM model m LEFT JOIN bounded bd ON bd.trace = m.trace LEFT JOIN bulk b ON b.trace = m.trace LEFT JOIN ion i ON i.trace = m.trace""",
        (*TO_ELIG, "bounded"), *TO_BULK),
)
def v2(spark, sf):
    traces = model_traces(spark, sf, halo=True)
    both = plan.configurations(traces, {"ordinary": MODEL, "bounded": BOUNDED})
    bulk = H.bulk_windows(both["bounded"], ["trace"], BOUNDED)
    ordinary = plan.fits_of(both["ordinary"], MODEL, ["trace"])
    bounded = plan.fits_of(both["bounded"], BOUNDED, ["trace"])
    return V.beam_comparison(ordinary, bounded, bulk, ["trace"]).select(
        "trace", rounded("bounded_te_eV", 6).alias("bounded_te_eV"), "bulk_candidate_found",
        rounded("bulk_candidate_te_eV", 3).alias("bulk_te_eV"), F.col("bulk_candidate_width_V").alias("bulk_width_V"),
        rounded(F.col("excess_background_A") * 1e6, 2).alias("excess_uA"), F.col("excess_background_5sigma").alias("excess_5sigma"),
    )
