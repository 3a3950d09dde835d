"""Shot statistics, spatial cleaning and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampfield.functions.physics import line_density_m2
from rampfield.operators import calibration as K
from rampfield.operators import shots_agg as A
from rampfield.operators import spatial as G
from rampfield.plans import trace as plan

from .common import (
    LINE_SQL, MAP_SQL, MODEL, PROFILE_SQL, R, Registry, line_profile, line_values, map_cells,
    model_traces, rounded,
)
from .traces import STAGES, TO_ELIG, cascade_sql, chain

reg = Registry()
BY = ["run", "iramp"]
BOUNDED = MODEL.with_(te_region_method="bounded")


def ints(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- A1 to A5 ------------------------------------------------------------------------


@reg.add(
    "A1_shot_statistics",
    "WITH " + LINE_SQL + f"""SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, {R('avg(value)', 5)} AS m, {R('stddev_samp(value)', 5)} AS sd, count(value) AS n,
       {R('avg(value) FILTER (value > 0)', 5)} AS valid_m, {R('stddev_samp(value) FILTER (value > 0)', 5)} AS valid_sd FROM line GROUP BY iramp, ix""",
)
def a1(spark, sf):
    rows = line_values(spark, sf)
    keys = ["iramp", "ix"]
    every = A.shot_statistics(rows, keys, {"value": "m"}, counts=["value"])
    valid = A.shot_statistics(rows, keys, {"value": "valid_m"}, valid=F.col("value") > 0)
    return every.join(valid, keys).select(
        *ints("iramp", "ix"), rounded("m", 5).alias("m"), rounded("m_std", 5).alias("sd"),
        F.col("m_count").alias("n"), rounded("valid_m", 5).alias("valid_m"), rounded("valid_m_std", 5).alias("valid_sd"),
    )


def fits(spark, sf):
    done = plan.analyze_traces(model_traces(spark, sf, True), BOUNDED, ["trace"])
    return done.withColumn("place", F.col("trace") % 7)


CASCADE = "WITH c AS MATERIALIZED (" + cascade_sql() + ") "


@reg.add(
    "A2_acceptance",
    CASCADE + """SELECT trace % 7 AS place, bool_or(ok) AS analysis_ok, count(*) FILTER (ok) AS analysis_valid_count,
       bool_or(coalesce(te_fit_r2 >= 0.95, false)) AS te_fit_passed_r2, count(te_eV) AS fit_count FROM c GROUP BY trace % 7""",
)
def a2(spark, sf):
    return A.acceptance(fits(spark, sf), ["place"]).select(
        "place", "analysis_ok", "analysis_valid_count", "te_fit_passed_r2", "fit_count"
    )


@reg.add(
    "A3_status_line",
    CASCADE + """, n AS (SELECT trace % 7 AS place, count(*) AS traces, count(te_eV) AS reported, count(*) FILTER (ok) AS accepted FROM c GROUP BY ALL),
w AS (SELECT trace % 7 AS place, warning, count(*) AS k FROM c WHERE NOT ok GROUP BY ALL),
t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY place ORDER BY k DESC, warning) = 1)
SELECT place, printf('Reported %d/%d finite per-shot fits; accepted %d/%d per-shot fits', reported, traces, accepted, traces)
   || coalesce(printf('; top rejection (%d): %s', k, warning), '') AS status FROM n LEFT JOIN t USING (place)""",
)
def a3(spark, sf):
    return A.status_line(fits(spark, sf), ["place"]).select("place", "status")


@reg.add(
    "A3_rejection_histogram",
    CASCADE + "SELECT warning AS reason, count(*) AS rejected FROM c WHERE NOT ok GROUP BY warning",
)
def a3_histogram(spark, sf):
    return A.rejection_histogram(fits(spark, sf))


@reg.add(
    "A4_representative_curves",
    chain(
        f"""SELECT n.trace // 5 AS place, n.j::BIGINT AS j, {R('avg(n.vg)', 5)} AS vg,
  {R('avg(s.ib + (n.vg - s.vb) * (s.inx - s.ib) / (s.vn - s.vb)) * 1e3', 5)} AS ig_mA, bool_or(n.vg >= l.x0 AND n.vg <= l.x1) AS fit_mask
  FROM (SELECT trace, j, va0 + j * ((va1 - va0) / 63) AS vg FROM shape, range(64) t(j)) n JOIN bounded l USING (trace)
  ASOF JOIN (SELECT * FROM bins WHERE vn IS NOT NULL) s ON n.trace = s.trace AND n.vg >= s.vb GROUP BY n.trace // 5, n.j""",
        *TO_ELIG, "bounded"),
)
def a4(spark, sf):
    shots = model_traces(spark, sf).withColumn("place", F.floor(F.col("trace") / 5))
    done = plan.analyze_traces(shots, BOUNDED, ["place", "trace"], with_grids=True)
    return A.representative_curves(done, ["place"]).select(
        *ints("place", "j"), rounded("vg", 5).alias("vg"), rounded(F.col("ig") * 1e3, 5).alias("ig_mA"), "fit_mask"
    )


@reg.add(
    "A5_unavailable_products",
    "WITH " + LINE_SQL + """SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, s::BIGINT AS ishot, NULL::DOUBLE AS te_eV, false AS ok,
       n >= 2 AS available, CASE WHEN n < 2 THEN 'unavailable; only one shot was configured'
       ELSE 'individual fits before spatial post-processing' END AS stage FROM prof, range(3) t(s)""",
)
def a5(spark, sf):
    places = line_values(spark, sf).groupBy("iramp", "ix").agg(F.count("value").alias("n"))
    available, stage = A.statistics_label("individual", F.col("n"))
    empty = A.unavailable_shot_products(places.withColumns({"available": available, "stage": stage}), 3)
    return empty.select(*ints("iramp", "ix", "ishot"), "te_eV", "ok", "available", "stage")


# --- G1 to G4 ------------------------------------------------------------------------

SPIKE_SQL = """
near AS (SELECT a.iramp, a.ix, median(b.m) AS med, count(b.m) AS n FROM p a LEFT JOIN p b
         ON a.iramp = b.iramp AND b.ix <> a.ix AND abs(b.ix - a.ix) <= 2 GROUP BY a.iramp, a.ix),
spk AS MATERIALIZED (SELECT p.*, coalesce(near.n >= 2 AND abs(m - med) > 400, false) AS spike FROM p JOIN near USING (iramp, ix)),
good AS (SELECT iramp, x, m AS y FROM spk WHERE m IS NOT NULL AND NOT spike),
cnt AS (SELECT iramp, count(*) AS g FROM good GROUP BY iramp),
ends AS (SELECT s.iramp, s.ix, max(CASE WHEN g.x < s.x THEN g.x END) AS xl, min(CASE WHEN g.x > s.x THEN g.x END) AS xr
         FROM spk s JOIN good g ON g.iramp = s.iramp GROUP BY s.iramp, s.ix),
clean AS MATERIALIZED (SELECT s.*, CASE WHEN spike AND m IS NOT NULL AND coalesce(c.g, 0) >= 2 THEN
     CASE WHEN xl IS NULL THEN r.y WHEN xr IS NULL THEN l.y ELSE l.y + (s.x - xl) * (r.y - l.y) / (xr - xl) END ELSE m END AS cl
   FROM spk s LEFT JOIN cnt c USING (iramp) LEFT JOIN ends e ON e.iramp = s.iramp AND e.ix = s.ix
   LEFT JOIN good l ON l.iramp = s.iramp AND l.x = xl LEFT JOIN good r ON r.iramp = s.iramp AND r.x = xr)
"""


def smooth_sql(value: str, source: str) -> str:
    return f"""SELECT a.iramp, a.ix, CASE WHEN any_value(a.{value}) IS NOT NULL THEN
   sum(exp(-0.5 * pow((b.ix - a.ix) / 1.5::DOUBLE, 2)) * b.{value}) / sum(CASE WHEN b.{value} IS NOT NULL THEN exp(-0.5 * pow((b.ix - a.ix) / 1.5::DOUBLE, 2)) END) END AS s
   FROM {source} a JOIN {source} b ON a.iramp = b.iramp AND abs(a.ix - b.ix) <= 2 GROUP BY a.iramp, a.ix"""


@reg.add("G1_line_spikes", "WITH " + PROFILE_SQL + "," + SPIKE_SQL + "SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, spike FROM spk")
def g1(spark, sf):
    return G.flag_line_spikes(line_profile(spark, sf), "m", BY, 2, 400.0).select(*ints("iramp", "ix"), "spike")


@reg.add(
    "G2_line_replacement",
    "WITH " + PROFILE_SQL + "," + SPIKE_SQL + f"SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, {R('cl', 5)} AS cleaned FROM clean",
)
def g2(spark, sf):
    flagged = G.flag_line_spikes(line_profile(spark, sf), "m", BY, 2, 400.0)
    return G.replace_line_spikes(flagged, "m", "spike", BY, out="cleaned").select(
        *ints("iramp", "ix"), rounded("cleaned", 5).alias("cleaned")
    )


@reg.add(
    "G3_line_smoothing",
    "WITH " + PROFILE_SQL + f"SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, {R('s', 5)} AS smooth FROM (" + smooth_sql("m", "p") + ")",
)
def g3(spark, sf):
    return G.smooth_line(line_profile(spark, sf), {"m": "smooth"}, BY, 2, 1.5).select(
        *ints("iramp", "ix"), rounded("smooth", 5).alias("smooth")
    )


def line_fields(spark, sf):
    return line_profile(spark, sf).withColumns(
        {"vp_V": F.col("m"), "te_eV": F.col("sd"), "vf_V": F.col("m") - 1, "ies_A": F.col("sd") * 2,
         "iis_A": F.col("sd") + F.col("m"), "n_e_m3": F.abs("m")}
    )


@reg.add(
    "G4_line_processing",
    "WITH " + PROFILE_SQL + "," + SPIKE_SQL + ", a AS (" + smooth_sql("cl", "clean") + "), b AS (" + smooth_sql("sd", "clean") + ")"
    + f"""SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, spike AS vp_spike, {R('a.s', 5)} AS vp, {R('b.s', 5)} AS te
        FROM clean JOIN a USING (iramp, ix) JOIN b USING (iramp, ix)""",
)
def g4(spark, sf):
    done = G.process_line(
        line_fields(spark, sf), BY, spike_half_window=2, threshold=400.0, smooth_half_window=2, sigma=1.5
    )
    return done.select(
        *ints("iramp", "ix"), "vp_spike", rounded("vp_V_processed", 5).alias("vp"), rounded("te_eV_processed", 5).alias("te")
    )


# --- G5 to G9 ------------------------------------------------------------------------

MAP_SPIKE = """
mnear AS (SELECT a.iramp, a.iy, a.ix, median(b.z) AS med, count(b.z) AS n FROM cells a LEFT JOIN cells b
   ON a.iramp = b.iramp AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 2 AND NOT (a.iy = b.iy AND a.ix = b.ix) GROUP BY ALL),
mspk AS MATERIALIZED (SELECT c.*, coalesce(m.n >= 2 AND abs(z - med) > 60, false) AS spike FROM cells c JOIN mnear m USING (iramp, iy, ix)),
mrep AS (SELECT a.iramp, a.iy, a.ix, median(b.z) FILTER (NOT b.spike) AS med FROM mspk a JOIN mspk b
   ON a.iramp = b.iramp AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 2 GROUP BY ALL),
mclean AS MATERIALIZED (SELECT s.*, CASE WHEN spike AND z IS NOT NULL THEN coalesce(med, z) ELSE z END AS cl FROM mspk s JOIN mrep USING (iramp, iy, ix))
"""


def map_smooth_sql(value: str, source: str) -> str:
    w = "exp(-0.5 * (pow(a.iy - b.iy, 2) + pow(a.ix - b.ix, 2)) / 2.25::DOUBLE)"
    return f"""SELECT a.iramp, a.iy, a.ix, CASE WHEN any_value(a.{value}) IS NOT NULL THEN sum({w} * b.{value}) / sum(CASE WHEN b.{value} IS NOT NULL THEN {w} END) END AS s
   FROM {source} a JOIN {source} b ON a.iramp = b.iramp AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 2 GROUP BY a.iramp, a.iy, a.ix"""


MAPKEYS = "iramp::BIGINT AS iramp, iy::BIGINT AS iy, ix::BIGINT AS ix"


@reg.add("G5_map_spikes", "WITH " + MAP_SQL + "," + MAP_SPIKE + f"SELECT {MAPKEYS}, spike FROM mspk")
def g5(spark, sf):
    return G.flag_map_spikes(map_cells(spark, sf), "z", BY, (1, 2), 60.0).select(*ints("iramp", "iy", "ix"), "spike")


@reg.add("G6_map_replacement", "WITH " + MAP_SQL + "," + MAP_SPIKE + f"SELECT {MAPKEYS}, {R('cl', 5)} AS cleaned FROM mclean")
def g6(spark, sf):
    flagged = G.flag_map_spikes(map_cells(spark, sf), "z", BY, (1, 2), 60.0)
    return G.replace_map_spikes(flagged, "z", "spike", BY, (1, 2), "cleaned").select(
        *ints("iramp", "iy", "ix"), rounded("cleaned", 5).alias("cleaned")
    )


@reg.add("G7_map_smoothing", "WITH " + MAP_SQL + f"SELECT {MAPKEYS}, {R('s', 5)} AS smooth FROM (" + map_smooth_sql("z", "cells") + ")")
def g7(spark, sf):
    return G.smooth_map(map_cells(spark, sf), {"z": "smooth"}, BY, (1, 2), 1.5).select(
        *ints("iramp", "iy", "ix"), rounded("smooth", 5).alias("smooth")
    )


def map_fields(spark, sf):
    return map_cells(spark, sf).withColumns(
        {"vp_V": F.col("z"), "te_eV": F.col("z") / 100, "vf_V": F.col("z") - 1, "ies_A": F.col("z") * 2,
         "iis_A": F.col("z") + 3, "n_e_m3": F.col("z")}
    )


@reg.add(
    "G8_map_processing",
    "WITH " + MAP_SQL + "," + MAP_SPIKE + ", a AS (" + map_smooth_sql("cl", "mclean") + "), b AS (" + map_smooth_sql("z", "mclean") + ")"
    + f"SELECT {MAPKEYS}, spike AS vp_spike, {R('a.s', 5)} AS vp, {R('b.s', 5)} AS n_e FROM mclean JOIN a USING (iramp, iy, ix) JOIN b USING (iramp, iy, ix)",
)
def g8(spark, sf):
    done = G.process_map(
        map_fields(spark, sf), BY, spike_half_window=(1, 2), threshold=60.0, smooth_half_window=(1, 2), sigma=1.5
    )
    return done.select(
        *ints("iramp", "iy", "ix"), "vp_spike", rounded("vp_V_processed", 5).alias("vp"), rounded("n_e_m3_processed", 5).alias("n_e")
    )


@reg.add(
    "G9_reported_version",
    "WITH " + PROFILE_SQL + "," + SPIKE_SQL + f"""SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, {R('cl', 5)} AS vp_V, {R('m', 5)} AS vp_V_raw, {R('sd', 5)} AS te_eV FROM clean""",
)
def g9(spark, sf):
    done = G.process_line(line_fields(spark, sf), BY, spike_half_window=2, threshold=400.0, smooth=False)
    return G.reported_version(done, reject=True, smooth=False).select(
        *ints("iramp", "ix"), rounded("vp_V", 5).alias("vp_V"), rounded("vp_V_raw", 5).alias("vp_V_raw"), rounded("te_eV", 5).alias("te_eV")
    )


# --- I1 to I6 ------------------------------------------------------------------------

LINE_DENSITY = line_density_m2(288.0, 3.5, 2.0)

FACTOR_SQL = """
fp AS (SELECT iramp, x, d, lead(d) OVER t AS dn, lead(x) OVER t AS xn FROM {source} WHERE d IS NOT NULL WINDOW t AS (PARTITION BY iramp ORDER BY x)),
fac AS MATERIALIZED (SELECT iramp, CASE WHEN count(*) >= 2 AND max(d) <> 0 THEN sum(0.5 * (d + dn) * (xn - x) * 0.01) / max(d) END AS f, max(d) AS top FROM fp GROUP BY iramp),
sc AS MATERIALIZED (SELECT iramp, f, top, CASE WHEN top > 0 AND f > 0 THEN 1.18e6::DOUBLE * 1e9 * 288 * 3.5 / 2 / f / top END AS scale FROM fac)
"""
LINE_D = ", dl AS (SELECT iramp, ix, x, abs(m) AS d, sd FROM p)"


@reg.add(
    "I1_shape_factor",
    "WITH " + PROFILE_SQL + LINE_D + "," + FACTOR_SQL.format(source="dl") + f"SELECT iramp::BIGINT AS iramp, {R('f', 8)} AS shape_factor_m, {R('top', 5)} AS n_max FROM fac",
)
def i1(spark, sf):
    return K.shape_factors(line_fields(spark, sf), BY).select(
        *ints("iramp"), rounded("shape_factor_m", 8).alias("shape_factor_m"), rounded("n_max", 5).alias("n_max")
    )


@reg.add(
    "I2_density_scale",
    "WITH " + PROFILE_SQL + LINE_D + "," + FACTOR_SQL.format(source="dl") + f"SELECT iramp::BIGINT AS iramp, {R('log10(scale)', 8)} AS log10_scale, {R('log10(scale * top)', 8)} AS log10_peak FROM sc",
)
def i2(spark, sf):
    done = K.with_scale(K.shape_factors(line_fields(spark, sf), BY), LINE_DENSITY)
    return done.select(
        *ints("iramp"), rounded(F.log10("density_scale"), 8).alias("log10_scale"), rounded(F.log10("peak_m3"), 8).alias("log10_peak")
    )


@reg.add(
    "I3_line_calibration",
    "WITH " + PROFILE_SQL + LINE_D + "," + FACTOR_SQL.format(source="dl")
    + f"""SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, {R('d / top', 8)} AS normalized, {R('CASE WHEN d > 0 THEN log10(d * scale) END', 8)} AS log10_scaled FROM dl JOIN sc USING (iramp)""",
)
def i3(spark, sf):
    done = K.calibrate_line(line_fields(spark, sf), BY, LINE_DENSITY)
    return done.select(
        *ints("iramp", "ix"), rounded("n_e_normalized", 8).alias("normalized"),
        rounded(F.when(F.col("n_e_scaled_m3") > 0, F.log10("n_e_scaled_m3")), 8).alias("log10_scaled"),
    )


ROW_SQL = """
rw AS MATERIALIZED (SELECT DISTINCT iramp, iy, y FROM cells QUALIFY row_number() OVER (PARTITION BY iramp ORDER BY abs(y - 0.7), iy) = 1),
ml AS (SELECT c.iramp, c.x, c.z AS d FROM cells c JOIN rw USING (iramp, iy))
"""


@reg.add("I4_nearest_row", "WITH " + MAP_SQL + "," + ROW_SQL + f"SELECT iramp::BIGINT AS iramp, iy::BIGINT AS row_iy, {R('y', 6)} AS row_y_cm FROM rw")
def i4(spark, sf):
    return K.nearest_row(map_cells(spark, sf), BY, 0.7).select(
        *ints("iramp", "row_iy"), rounded("row_y_cm", 6).alias("row_y_cm")
    )


@reg.add(
    "I5_map_calibration",
    "WITH " + MAP_SQL + "," + ROW_SQL + "," + FACTOR_SQL.format(source="ml")
    + f"SELECT {MAPKEYS}, {R('log10(z * scale)', 8)} AS log10_scaled, {R('f', 8)} AS shape_factor_m FROM cells LEFT JOIN sc USING (iramp)",
)
def i5(spark, sf):
    done = K.calibrate_map(map_fields(spark, sf), BY, LINE_DENSITY, 0.7)
    return done.select(
        *ints("iramp", "iy", "ix"), rounded(F.log10("n_e_scaled_m3"), 8).alias("log10_scaled"),
        rounded("shape_factor_m", 8).alias("shape_factor_m"),
    )


@reg.add(
    "I6_deviation_scale",
    "WITH " + PROFILE_SQL + LINE_D + "," + FACTOR_SQL.format(source="dl")
    + f"SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, {R('log10(sd * scale)', 8)} AS log10_std FROM dl JOIN sc USING (iramp)",
)
def i6(spark, sf):
    line = line_fields(spark, sf).withColumn("n_e_m3_std", F.col("sd"))
    done = K.scale_deviation(K.calibrate_line(line, BY, LINE_DENSITY), ["run"], 5)
    return done.select(*ints("iramp", "ix"), rounded(F.log10("n_e_m3_std"), 8).alias("log10_std"))
