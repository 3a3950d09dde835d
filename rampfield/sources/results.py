"""Result tables of a scan: writing, discovery, validated reading and summaries.

A result root holds the tables ``fits, profiles, waveforms, iv_grid, runs`` in
Parquet, partitioned by geometry and run.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calibration import shape_factors
from ..params import GEOMETRIES
from .store import read_table

TABLES = ("fits", "profiles", "waveforms", "iv_grid", "runs")
PARTITIONS = ("geometry", "run")
BASE = ("te_eV", "vp_V", "vf_V", "ies_A", "iis_A", "n_e_m3")

# Fields every stored profile must have; extra fields are allowed.
REQUIRED_PROFILE = (
    "x_cm", "isat_A", *BASE, *(f"{b}_raw" for b in BASE), *(f"{b}_processed" for b in BASE),
    "vp_spike", "analysis_ok", "analysis_valid_count", "te_fit_r2", "te_fit_rmse_logI",
    "te_fit_npts", "te_fit_vstart_V", "te_fit_vstop_V", "te_fit_slope_logI_per_V",
    "te_fit_intercept_logI", "te_fit_i0_A", "te_fit_passed_r2", "te_fit_candidate_count",
)
REQUIRED_BY_GEOMETRY = {"x_line": REQUIRED_PROFILE, "xy_plane": (*REQUIRED_PROFILE, "y_cm")}

# The fields a summary needs.
SUMMARY_FIELDS = (
    "x_cm", "y_cm", *BASE, *(f"{b}_std" for b in BASE), "te_eV_raw", "vp_V_raw", "analysis_ok",
    "analysis_valid_count", "vp_spike", "te_fit_r2", "ramp_center_time_s",
)
POSITION = ("iy", "ix", "iramp")


# --- SNK1, SNK2 ----------------------------------------------------------------------


def write_table(df: DataFrame, root: str, table: str) -> None:
    """SNK1: writes one result table; only the (geometry, run) partitions present are replaced."""
    if table not in TABLES:
        raise ValueError(f"Unknown result table {table!r}.")
    (
        df.write.partitionBy(*PARTITIONS)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(f"{root}/{table}")
    )


def compact_arrays(
    profiles: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """SNK2: one row per key with every field as an array in (iy, ix) order.

    ``positions`` and ``axis_order`` say which cell each element belongs to.  A
    row holds one scan grid, whose size the acquisition fixes.
    """
    cell = F.struct("iy", "ix", *fields)
    gathered = profiles.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    return gathered.select(
        *keys,
        F.lit("y,x").alias("axis_order"),
        F.transform("_cells", lambda c: F.struct(c["iy"].alias("iy"), c["ix"].alias("ix"))).alias(
            "positions"
        ),
        *[F.col("_cells").getField(f).alias(f) for f in fields],
    )


# --- RD1, RD2 ------------------------------------------------------------------------


def stored_geometries(spark: SparkSession, root: str, table: str = "profiles") -> DataFrame:
    """RD1: geometries present, from the partition values alone."""
    return read_table(spark, root, table).select("geometry").distinct()


def choose_geometry(spark: SparkSession, root: str, geometry: str | None = None) -> str:
    """RD1: the requested geometry, or the only one; otherwise an error."""
    present = sorted(r["geometry"] for r in stored_geometries(spark, root).take(len(GEOMETRIES) + 1))
    if not present:
        raise ValueError("no result geometry is stored.")
    if geometry is None:
        if len(present) > 1:
            raise ValueError(f"several geometries are stored ({', '.join(present)}); choose one.")
        return present[0]
    if geometry not in GEOMETRIES:
        raise ValueError(f"Unsupported geometry {geometry!r}.")
    if geometry not in present:
        raise ValueError(f"no {geometry} results are stored.")
    return geometry


def missing_fields(df: DataFrame, geometry: str) -> list[str]:
    """Required fields a profile table lacks, from its schema alone."""
    return sorted(set(REQUIRED_BY_GEOMETRY[geometry]) - set(df.columns))


def read_results(
    spark: SparkSession,
    root: str,
    geometry: str | None = None,
    fields: Iterable[str] | None = None,
    summary_only: bool = False,
    run: str | None = None,
) -> DataFrame:
    """RD2: profiles of one geometry: all fields, the summary fields, or those named.

    The schema is checked before anything is read; the geometry and run filters
    prune partitions and the field list prunes columns.
    """
    if summary_only and fields is not None:
        raise ValueError("summary_only and fields cannot be used together.")
    chosen = choose_geometry(spark, root, geometry)
    table = read_table(spark, root, "profiles")
    missing = missing_fields(table, chosen)
    if missing:
        raise ValueError(f"stored {chosen} results lack required fields: {missing}")
    rows = table.where(F.col("geometry") == chosen)
    if run is not None:
        rows = rows.where(F.col("run") == run)
    keys = [*PARTITIONS, *POSITION]
    if summary_only:
        names = [f for f in SUMMARY_FIELDS if f in table.columns]
    elif fields is None:
        names = [c for c in table.columns if c not in keys]
    else:
        names = list(fields)
        absent = sorted(set(names) - set(table.columns))
        if absent:
            raise KeyError(f"requested fields are not stored: {absent}")
    return rows.select(*keys, *[n for n in names if n not in keys])


# --- RD3, RD4 ------------------------------------------------------------------------


def inventory(profiles: DataFrame) -> DataFrame:
    """RD3: one row per (geometry, field) with type, extents and non-null count."""
    fields = [c for c in profiles.columns if c not in (*PARTITIONS, *POSITION)]
    kinds = dict(profiles.dtypes)
    counted = profiles.groupBy("geometry").agg(
        F.countDistinct("iy").alias("ny"), F.countDistinct("ix").alias("nx"),
        F.countDistinct("iramp").alias("nramps"),
        *[F.count(f).alias(f"_c_{i}") for i, f in enumerate(fields)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.lit(kinds[f]).alias("type"),
                F.col(f"_c_{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counted.select("geometry", "ny", "nx", "nramps", F.explode(entries).alias("_e")).select(
        "geometry", "_e.field", "_e.type", "ny", "nx", "nramps", "_e.non_null"
    )


def summary_metrics(profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """RD4: accepted analyses, finite fits, fits under the R^2 limit and shape factor per run.

    ``runs`` gives ``te_min_r2`` and, if stored, ``shape_factor_m``.  A missing
    factor is recomputed for single-ramp x-lines only.
    """
    keys = list(PARTITIONS)
    limits = runs.select(
        *keys, F.coalesce("te_min_r2", F.lit(0.90)).alias("te_min_r2"),
        (F.col("shape_factor_m") if "shape_factor_m" in runs.columns else F.lit(None).cast("double")).alias("_stored"),
    )
    # A run's limit is one value, so poor fits can be counted after the join.
    rows = profiles.join(limits, keys)
    counted = rows.groupBy(*keys).agg(
        F.sum("analysis_valid_count").alias("accepted"), F.count("te_fit_r2").alias("finite_fits"),
        F.count_if(F.col("te_fit_r2") < F.col("te_min_r2")).alias("poor_fits"),
        F.max("iramp").alias("_last_ramp"), F.max("_stored").alias("_stored"),
    )
    lines = profiles.where(F.col("geometry") == "x_line")
    factors = shape_factors(lines, keys, "n_e_m3", "x_cm").select(
        *keys, F.col("shape_factor_m").alias("_line")
    )
    joined = counted.join(factors, keys, "left")
    usable = F.when(F.col("_last_ramp") == 0, F.col("_line"))
    return joined.select(
        *keys, "accepted", "finite_fits", "poor_fits",
        F.coalesce("_stored", usable).alias("shape_factor_m"),
    )
