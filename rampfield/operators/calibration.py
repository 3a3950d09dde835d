"""Density calibration against a line-integrated measurement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- I1, I2, I3 ----------------------------------------------------------------------


def shape_factors(
    line: DataFrame, by: Sequence[str], density: str = "n_e_m3", x: str = "x_cm"
) -> DataFrame:
    """(by, shape_factor_m, n_max, n_finite): trapezoid of the density over its peak, in m.

    Only points with position and density count; below two, or with a zero peak,
    the factor is NULL.
    """
    points = line.where(F.col(x).isNotNull() & F.col(density).isNotNull())
    w = Window.partitionBy(*by).orderBy(x)
    strip = (
        0.5 * (F.col(density) + F.lead(density).over(w)) * (F.lead(x).over(w) - F.col(x)) * 0.01
    )
    summed = points.withColumn("_strip", strip).groupBy(*by).agg(
        F.sum("_strip").alias("_area"), F.max(density).alias("n_max"),
        F.count(density).alias("n_finite"),
    )
    return summed.withColumn(
        "shape_factor_m",
        F.when((F.col("n_finite") >= 2) & (F.col("n_max") != 0), F.col("_area") / F.col("n_max")),
    ).drop("_area")


def with_scale(factors: DataFrame, line_density_m2: float) -> DataFrame:
    """Adds ``peak_m3`` and ``density_scale``; NULL unless peak, factor and line density are positive."""
    positive = (F.col("n_max") > 0) & (F.col("shape_factor_m") > 0) & F.lit(line_density_m2 > 0)
    out = factors.withColumn(
        "peak_m3", F.when(positive, F.lit(float(line_density_m2)) / F.col("shape_factor_m"))
    )
    return out.withColumn("density_scale", F.col("peak_m3") / F.col("n_max"))


def _scaled(rows: DataFrame, density: str) -> DataFrame:
    return rows.withColumns(
        {
            "n_e_normalized": F.when(
                F.col("density_scale").isNotNull(), F.col(density) / F.col("n_max")
            ),
            "n_e_scaled_m3": F.col(density) * F.col("density_scale"),
        }
    )


def calibrate_line(
    line: DataFrame, by: Sequence[str], line_density_m2: float, density: str = "n_e_m3",
    x: str = "x_cm",
) -> DataFrame:
    """Calibrates every ramp of an x-line on its own.

    Adds ``shape_factor_m, density_scale, n_e_normalized, n_e_scaled_m3``.
    """
    factors = with_scale(shape_factors(line, by, density, x), line_density_m2)
    return _scaled(line.join(factors, list(by), "left"), density)


# --- I4, I5 --------------------------------------------------------------------------


def nearest_row(
    cells: DataFrame, by: Sequence[str], requested_y_cm: float, y: str = "y_cm"
) -> DataFrame:
    """I4: (by, row_iy, row_y_cm) of the map row nearest a y; the lowest index on a tie."""
    rank = F.struct(F.abs(F.col(y) - float(requested_y_cm)), F.col("iy"))
    best = F.min_by(F.struct(F.col("iy").alias("iy"), F.col(y).alias("y")), rank)
    return cells.where(F.col(y).isNotNull()).groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.iy").alias("row_iy"), F.col("_b.y").alias("row_y_cm")
    )


def calibrate_map(
    cells: DataFrame, by: Sequence[str], line_density_m2: float, requested_y_cm: float = 0.0,
    density: str = "n_e_m3", x: str = "x_cm", y: str = "y_cm",
) -> DataFrame:
    """Scales every ramp's map by the factor of its row nearest a y."""
    rows = nearest_row(cells, by, requested_y_cm, y)
    chosen = cells.join(rows, list(by)).where(F.col("iy") == F.col("row_iy"))
    factors = with_scale(shape_factors(chosen, by, density, x), line_density_m2)
    marked = rows.join(factors, list(by), "left")
    return _scaled(cells.join(marked, list(by), "left"), density)


# --- I6 ------------------------------------------------------------------------------


def scale_deviation(
    calibrated: DataFrame, runs: Sequence[str], nramps: int, std: str = "n_e_m3_std"
) -> DataFrame:
    """Scales the density deviation by the ramp's factor.

    With several ramps of which none could be calibrated the deviation is kept;
    otherwise a missing factor makes it NULL.
    """
    any_valid: Column = F.lit(True)
    if nramps > 1:
        per_run = (
            calibrated.groupBy(*runs).agg(F.count("density_scale").alias("_valid"))
        )
        calibrated = calibrated.join(per_run, list(runs))
        any_valid = F.col("_valid") > 0
    out = calibrated.withColumn(
        std, F.when(any_valid, F.col(std) * F.col("density_scale")).otherwise(F.col(std))
    )
    return out.drop("_valid")
