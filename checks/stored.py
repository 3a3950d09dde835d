"""Writing results and reading them back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rampfield.operators import spatial as G
from rampfield.plans.scan import CURVES, run_scan
from rampfield.sources import results as Z
from rampfield.sources.store import read_table

from .common import MAP_SQL, PROFILE_SQL, R, SMALL_SCAN, SMALL_SCAN_SQL, Registry, replace, rounded, shared_root, small_scan_shots
from .grids import BY, line_fields, map_fields
from .signals import SMOOTH_SQL

reg = Registry()


def _complete(df, geometry, run):
    """A profile table with every stored field, from cleaned fields of a line or map."""
    named = G.reported_version(df, reject=False, smooth=False)
    extra = {
        "isat_A": F.col("te_eV"), "analysis_ok": F.col("vp_V").isNotNull(),
        "analysis_valid_count": F.when(F.col("vp_V").isNotNull(), F.lit(2)).otherwise(F.lit(0)).cast("bigint"),
        "te_fit_r2": F.when(F.col("vp_V").isNotNull(), 1 - F.lit(0.01) * (F.col("ix") % 9)), "te_fit_rmse_logI": F.lit(0.1),
        "te_fit_npts": F.lit(20.0), "te_fit_vstart_V": F.col("vf_V"), "te_fit_vstop_V": F.col("vp_V"),
        "te_fit_slope_logI_per_V": F.lit(0.3), "te_fit_intercept_logI": F.lit(-9.0), "te_fit_i0_A": -F.col("iis_A"),
        "te_fit_passed_r2": F.lit(True), "te_fit_candidate_count": F.lit(1).cast("bigint"),
    }
    return named.withColumns(extra).withColumns({"geometry": F.lit(geometry), "run": F.lit(run)})


def line_table(spark, sf):
    done = G.process_line(line_fields(spark, sf), BY, reject=False, smooth=False)
    return _complete(done, "x_line", "c").drop("m", "sd").withColumn("y_cm", F.lit(0.0))


def map_table(spark, sf):
    done = G.process_map(map_fields(spark, sf), BY, reject=False, smooth=False)
    return _complete(done, "xy_plane", "p").drop("z")


def stored(spark, sf):
    """A root with both geometries, the line written twice so that its first version is replaced."""
    root = shared_root(spark)
    line, cells = line_table(spark, sf), map_table(spark, sf)
    columns = [c for c in cells.columns if c in line.columns]
    Z.write_table(line.withColumn("vp_V", F.lit(-1.0)).select(*columns), root, "profiles")
    Z.write_table(cells.select(*columns), root, "profiles")
    Z.write_table(line.select(*columns), root, "profiles")
    return root


@reg.add(
    "SNK1_partition_overwrite",
    "WITH " + PROFILE_SQL + "," + MAP_SQL + f"""SELECT 'x_line' AS geometry, 'c' AS run, count(*) AS n, {R('sum(m)', 3)} AS total FROM p
       UNION ALL SELECT 'xy_plane', 'p', count(*), {R('sum(z)', 3)} FROM cells""",
)
def snk1(spark, sf):
    back = spark.read.parquet(f"{stored(spark, sf)}/profiles")
    return back.groupBy("geometry", "run").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("vp_V"), 3).alias("total")
    )


@reg.add(
    "SNK2_compact_arrays",
    "WITH " + MAP_SQL + f""", o AS (SELECT *, row_number() OVER (PARTITION BY iramp ORDER BY iy, ix) AS r FROM cells)
SELECT iramp::BIGINT AS iramp, 'y,x' AS axis_order, count(*) AS n, {R('sum(r * coalesce(z, 0))', 2)} AS weighted, count(z) AS present FROM o GROUP BY iramp""",
)
def snk2(spark, sf):
    arrays = Z.compact_arrays(map_fields(spark, sf), ["run", "iramp"], ["vp_V", "n_e_m3"])
    weighted = F.aggregate(
        F.transform("vp_V", lambda x, k: (k + 1) * F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
    )
    return arrays.select(
        F.col("iramp").cast("bigint").alias("iramp"), "axis_order", F.size("positions").cast("bigint").alias("n"),
        F.round(weighted, 2).alias("weighted"), F.size(F.array_compact("n_e_m3")).cast("bigint").alias("present"),
    )


@reg.add("RD1_stored_geometries", "SELECT * FROM (VALUES ('x_line'), ('xy_plane')) t(geometry) WHERE (SELECT count(*) FROM customer) > 0")
def rd1(spark, sf):
    return Z.stored_geometries(spark, stored(spark, sf))


@reg.add(
    "RD2_summary_read",
    "WITH " + PROFILE_SQL + f"SELECT iramp::BIGINT AS iramp, ix::BIGINT AS ix, {R('m', 5)} AS vp_V, {R('sd', 5)} AS te_eV, {R('x', 4)} AS x_cm FROM p",
)
def rd2(spark, sf):
    rows = Z.read_results(spark, stored(spark, sf), "x_line", summary_only=True, run="c")
    return rows.select(
        F.col("iramp").cast("bigint").alias("iramp"), F.col("ix").cast("bigint").alias("ix"),
        rounded("vp_V", 5).alias("vp_V"), rounded("te_eV", 5).alias("te_eV"), rounded("x_cm", 4).alias("x_cm"),
    )


#: stored fields by the geometry's rows they are NULL in: none; those without a mean; of a line, those without a mean of vp_V only
_ALWAYS = ["x_cm", "y_cm", "te_fit_rmse_logI", "te_fit_npts", "te_fit_slope_logI_per_V", "te_fit_intercept_logI"]
_COUNTS, _FLAGS = ["analysis_valid_count", "te_fit_candidate_count"], ["vp_spike", "analysis_ok", "te_fit_passed_r2"]
_GAPPY = [f"{n}{v}" for n in ("vp_V", "vf_V", "iis_A", "n_e_m3") for v in ("", "_raw", "_processed")] + [
    "te_fit_r2", "te_fit_vstart_V", "te_fit_vstop_V", "te_fit_i0_A"
]
_DEVIATIONS = [f"{n}{v}" for n in ("te_eV", "ies_A") for v in ("", "_raw", "_processed")] + ["isat_A"]


def inventory_sql() -> str:
    kinds = {**dict.fromkeys(_ALWAYS + _GAPPY + _DEVIATIONS, "double"), **dict.fromkeys(_COUNTS, "bigint"), **dict.fromkeys(_FLAGS, "boolean")}
    held = lambda f: "k" if f in _GAPPY else "d" if f in _DEVIATIONS else "n"
    listed = ", ".join(f"('{f}', '{kind}', '{held(f)}')" for f, kind in kinds.items())
    return "WITH " + PROFILE_SQL + "," + MAP_SQL + f"""SELECT geometry, field, type, ny, nx, nramps, CASE held WHEN 'k' THEN k WHEN 'd' THEN d ELSE n END AS non_null FROM (
   SELECT 'x_line' AS geometry, 1::BIGINT AS ny, count(DISTINCT ix) AS nx, count(DISTINCT iramp) AS nramps, count(*) AS n, count(m) AS k, count(sd) AS d FROM p
   UNION ALL SELECT 'xy_plane', count(DISTINCT iy), count(DISTINCT ix), count(DISTINCT iramp), count(*), count(z), count(z) FROM cells), (VALUES {listed}) t(field, type, held)"""


@reg.add("RD3_inventory", inventory_sql())
def rd3(spark, sf):
    return Z.inventory(spark.read.parquet(f"{stored(spark, sf)}/profiles"))


@reg.add(
    "RD4_summary_metrics",
    "WITH " + PROFILE_SQL + "," + MAP_SQL + f"""SELECT 'x_line' AS geometry, 'c' AS run, 2 * count(m)::BIGINT AS accepted, count(m) AS finite_fits,
   count(*) FILTER (m IS NOT NULL AND 1 - 0.01::DOUBLE * (ix % 9) < 0.945) AS poor_fits, NULL::DOUBLE AS shape_factor_m FROM p
   UNION ALL SELECT 'xy_plane', 'p', 2 * count(z)::BIGINT, count(z), count(*) FILTER (z IS NOT NULL AND 1 - 0.01::DOUBLE * (ix % 9) < 0.945), {R('0.15', 4)} FROM cells""",
)
def rd4(spark, sf):
    profiles = spark.read.parquet(f"{stored(spark, sf)}/profiles")
    runs = profiles.select("geometry", "run").distinct().withColumns(
        {"te_min_r2": F.lit(0.945), "shape_factor_m": F.when(F.col("geometry") == "xy_plane", F.lit(0.15))}
    )
    return Z.summary_metrics(profiles, runs)


# --- a whole scan --------------------------------------------------------------------
# The vectors are no sweeps, so every fit is rejected: its numbers are NULL, its counts 0.

SCAN_SQL = SMALL_SCAN_SQL + "," + SMOOTH_SQL % {"y": "v"} + """,
vs AS (SELECT run, iy, ix, ishot, shotnum, iramp, k, m + b1 * e + b2 * (e * e - 17.5 / 6) AS y FROM q JOIN (SELECT DISTINCT run, shotnum, iy, ix, ishot FROM ramps) USING (run, shotnum)),
""" + re.sub(r"\b([wq])\b(?=\.| AS| JOIN)", r"\1i", SMOOTH_SQL % {"y": "i"}) + """,
cs AS (SELECT run, iy, ix, ishot, shotnum, iramp, k, m + b1 * e + b2 * (e * e - 17.5 / 6) AS y FROM qi JOIN (SELECT DISTINCT run, shotnum, iy, ix, ishot FROM ramps) USING (run, shotnum)),
sh AS MATERIALIZED (SELECT run, iy, ix, ishot, iramp, list_avg(i[3:7]) AS isat, dc FROM ramps),
pr AS MATERIALIZED (SELECT run, iy, ix, iramp, avg(isat) AS isat, stddev_samp(isat) AS sd FROM sh GROUP BY ALL)
"""

# Runs that are not whole are left out by run_scan: every channel needs each shot once, in full length.
WHOLE_SCAN_SQL = SCAN_SQL.replace("FROM embeddings),", f"""FROM embeddings),
whole AS (SELECT run FROM shots GROUP BY run HAVING {" AND ".join(
    f"count(*) FILTER (channel = {c}) = {SMALL_SCAN.last_shot} AND count(DISTINCT shotnum) FILTER (channel = {c}) = {SMALL_SCAN.last_shot}"
    for c in (SMALL_SCAN.voltage_channel, SMALL_SCAN.current_channel))}
  AND min(len(y)) = {SMALL_SCAN.nt_full} AND max(len(y)) = {SMALL_SCAN.nt_full}),""", 1).replace("FROM shots),", "FROM shots JOIN whole USING (run)),", 1)


def scanned(spark, sf, mode):
    root = shared_root(spark)
    run_scan(spark, small_scan_shots(spark, sf), replace(SMALL_SCAN, shot_mode=mode), root, incomplete="skip")
    return root


@reg.add(
    "SNK1_scan_products",
    "WITH " + WHOLE_SCAN_SQL + f"""
SELECT 'shots' AS stored, run, iy::BIGINT AS iy, ix::BIGINT AS ix, ishot::BIGINT AS ishot, iramp, {R('isat', 8)} AS a, {R('dc', 8)} AS b,
  {R('(SELECT sum(y) FROM vs WHERE vs.run = sh.run AND vs.iy = sh.iy AND vs.ix = sh.ix AND vs.ishot = sh.ishot AND vs.iramp = sh.iramp)', 4)} AS c, 0::BIGINT AS n FROM sh
UNION ALL SELECT 'profiles', run, iy, ix, NULL, iramp, {R('isat', 8)}, {R('sd', 8)}, {R('(8 + 16 * iramp + 5.5) * 1e-6', 9)}, 0 FROM pr
UNION ALL SELECT 'fits', run, iy, ix, ishot, iramp, NULL, {R('dc', 8)}, NULL, 0 FROM sh
UNION ALL SELECT 'waveforms', run, iy, ix, NULL, iramp, {R('sum(v) / 2', 4)}, {R('sum(i) / 2', 6)}, {R('max(k) * 1e-6', 9)}, count(*) // 2 FROM samples GROUP BY run, iy, ix, iramp
UNION ALL SELECT 'runs', run, NULL, NULL, NULL, NULL, 0.95, 1e-6, NULL, 50 FROM (SELECT DISTINCT run FROM sh)""",
)
def snk1_scan(spark, sf):
    """Every stored table of scans that were written in one commit."""
    root = scanned(spark, sf, "individual")
    null, big = F.lit(None).cast("bigint"), lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    as_double = F.lit(None).cast("double")
    out = [
        read_table(spark, root, "shots").select(
            F.lit("shots").alias("stored"), "run", *big("iy", "ix", "ishot", "iramp"), rounded("isat_A", 8).alias("a"),
            rounded("dc_offset_A", 8).alias("b"), rounded(total("v_smooth_V"), 4).alias("c"), F.col("ok").cast("bigint").alias("n"),
        ),
        read_table(spark, root, "profiles").select(
            F.lit("profiles"), "run", *big("iy", "ix"), null, *big("iramp"), rounded("isat_A", 8), rounded("isat_A_std", 8),
            rounded("ramp_center_time_s", 9), "analysis_valid_count",
        ),
        read_table(spark, root, "fits").join(read_table(spark, root, "shots").select("run", "iy", "ix", "ishot", "iramp", "dc_offset_A"), ["run", "iy", "ix", "ishot", "iramp"])
        .select(F.lit("fits"), "run", *big("iy", "ix", "ishot", "iramp"), "te_eV", rounded("dc_offset_A", 8), "vp_V", F.col("ok").cast("bigint")),
        read_table(spark, root, "waveforms").groupBy("run", "iy", "ix", "iramp").agg(
            F.round(F.sum("v"), 4).alias("a"), F.round(F.sum("i"), 6).alias("b"), F.round(F.max("t_s"), 9).alias("c"), F.count("i_smooth").alias("n"),
        ).select(F.lit("waveforms"), "run", *big("iy", "ix"), null, *big("iramp"), "a", "b", "c", "n"),
        read_table(spark, root, "runs").select(
            F.lit("runs"), "run", null, null, null, null, "te_min_r2", "dt_s", as_double, F.col("acquired_traces").cast("bigint"),
        ),
    ]
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    return every


#: stored fields by what they hold for rejected fits
PROFILE_NULLS = [
    *(f"{b}{v}" for b in Z.BASE for v in ("", "_raw", "_processed", "_std")),
    *(f"te_fit_{n}{s}" for n in ("r2", "rmse_logI", "npts", "vstart_V", "vstop_V", "slope_logI_per_V", "intercept_logI", "i0_A") for s in ("", "_std")),
]
PROFILE_ZEROS = ["analysis_ok", "analysis_valid_count", "fit_count", "te_fit_candidate_count", "te_fit_count", "te_fit_passed_r2", "vp_spike"]
SHOT_NULLS = [*Z.BASE, "te_fit_r2", "te_fit_rmse", "te_fit_vstart", "te_fit_vstop", "te_fit_slope", "te_fit_intercept", "te_fit_i0"]
SHOT_ZEROS = ["ok", "statistics_fit", "te_fit_candidate_count", "te_fit_passed_r2"]


def export_sql(mode: str) -> str:
    values = lambda names: ", ".join(f"('{n}')" for n in names)
    cell = "((iy * 5 + ix) * 3 + iramp)"
    per_shot = "(((iy * 5 + ix) * 2 + ishot) * 3 + iramp)"
    number = (lambda x: "NULL::DOUBLE") if mode == "average" else (lambda x: x)
    points = "NULL" if mode == "average" else "0"
    return "WITH " + SCAN_SQL + f""",
cells AS (
  SELECT run, 'profile' AS product, field, 75 AS size, {cell} AS spot, v FROM (
    SELECT run, iy, ix, iramp, unnest(['isat_A', 'isat_A_std', 'x_cm', 'y_cm', 'ramp_start_index', 'ramp_end_index', 'ramp_start_time_s', 'ramp_center_time_s']) AS field,
      unnest([isat, {number('sd')}, ix * 2.0 - 4, iy * 5.0 - 10, 8 + 16 * iramp, 19 + 16 * iramp, (8 + 16 * iramp) * 1e-6::DOUBLE, (13.5 + 16 * iramp) * 1e-6::DOUBLE]) AS v FROM pr)
  UNION ALL SELECT run, 'profile', field, 75, {cell}, NULL FROM pr, (VALUES {values(PROFILE_NULLS)}) t(field)
  UNION ALL SELECT run, 'profile', field, 75, {cell}, 0 FROM pr, (VALUES {values(PROFILE_ZEROS)}) t(field)
  UNION ALL SELECT run, 'shot', unnest(['isat_A', 'dc_offset_A']), 150, {per_shot}, unnest([isat, dc]) FROM sh
  UNION ALL SELECT run, 'shot', field, 150, {per_shot}, NULL FROM sh, (VALUES {values(SHOT_NULLS)}) t(field)
  UNION ALL SELECT run, 'shot', field, 150, {per_shot}, 0 FROM sh, (VALUES {values(SHOT_ZEROS)}) t(field)
  UNION ALL SELECT run, 'shot', 'te_fit_npts', 150, {per_shot}, {points} FROM sh
  UNION ALL SELECT run, 'shot', 'v_smooth_V', 1800, {per_shot} * 12 + k, y FROM vs
  UNION ALL SELECT run, 'shot', 'i_smooth_A', 1800, {per_shot} * 12 + k, y FROM cs)
SELECT run, product, field, spot // 4092 AS block, 4092 * (spot // 4092) AS "offset", count(*) AS n, count(v) AS present,
  {R('sum((spot % 4092 + 1) * coalesce(v, 0))', 3)} AS weighted FROM cells GROUP BY ALL"""


def exported(spark, sf, mode):
    """All fields of the compact export but the curve grids, which tests compare."""
    arrays = read_table(spark, scanned(spark, sf, mode), "arrays").where(~F.col("field").isin(*CURVES, "didv"))
    weighted = F.aggregate(F.transform("values", lambda v, k: (k + 1) * F.coalesce(v, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return arrays.select(
        "run", "product", "field", F.col("block").cast("bigint").alias("block"), F.col("offset").cast("bigint").alias("offset"),
        F.size("values").cast("bigint").alias("n"), F.size(F.array_compact("values")).cast("bigint").alias("present"), F.round(weighted, 3).alias("weighted"),
    )


for _mode in ("individual", "average"):
    reg.add(f"SNK2_scan_export_{_mode}", export_sql(_mode))(lambda spark, sf, m=_mode: exported(spark, sf, m))
