"""Scan geometry inferred from a motion list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import LENGTH_TO_CM
from ..operators.keys import attach_by_key, position_in_group
from .scratch import written

# Fixed value: positions closer than this are the same, in cm.
TOLERANCE_CM = 1e-8


def motion_in_cm(motion: DataFrame) -> DataFrame:
    """Targets in cm; an unknown unit fails the query."""
    factor = F.create_map(*[F.lit(x) for kv in LENGTH_TO_CM.items() for x in kv])[F.col("unit")]
    known = motion.where(
        F.assert_true(factor.isNotNull(), F.lit("motion units are not a length")).isNull()
    )
    return known.select(
        "config", "shotnum", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y")
    )


def infer_geometry(motion: DataFrame, geometry: str, shots_per_bucket: int = 65536) -> DataFrame:
    """SRC6: one row per configuration with the scan layout, or the first violated rule.

    Every position must be one run of consecutive shots.  A run starts where the
    target differs from the previous shot's; the previous shot is found by an
    equi-join on the shot number, so no configuration is sorted as a whole.
    Runs are then numbered in acquisition order bucket by bucket.
    """
    if geometry not in ("x_line", "xy_plane"):
        raise ValueError(f"Unsupported analysis geometry {geometry!r}.")
    plane = geometry == "xy_plane"
    keys = ["config"]
    shots = motion_in_cm(motion)
    overall = shots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("shotnum").alias("nd"),
        F.min("shotnum").alias("first"), F.max("shotnum").alias("last_shot"),
        F.count("x").alias("nx_set"), F.count("y").alias("ny_set"),
        (F.max("y") - F.min("y")).alias("y_spread"),
    )
    before = shots.select(
        "config", (F.col("shotnum") + 1).alias("shotnum"),
        F.col("x").alias("px"), F.col("y").alias("py"), F.lit(True).alias("has_before"),
    )
    moved = F.abs(F.col("x") - F.col("px")) > TOLERANCE_CM
    if plane:
        moved = moved | (F.abs(F.col("y") - F.col("py")) > TOLERANCE_CM)
    starts = (
        shots.join(before, ["config", "shotnum"], "left")
        .where(F.col("has_before").isNull() | F.coalesce(moved, F.lit(True)))
        .select(
            "config", "shotnum", F.round("x", 8).alias("x"),
            (F.round("y", 8) if plane else F.lit(0.0)).alias("y"),
        )
    )
    # few rows, used several times below
    runs = written(position_in_group(starts, keys, ["shotnum"], "pos"))
    revisited = runs.groupBy("config", "x", "y").agg(F.count(F.lit(1)).alias("_v")).groupBy(
        *keys
    ).agg(F.max("_v").alias("visits"))
    axes = _axis(runs, "x").join(_axis(runs, "y"), keys)
    summary = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.min(F.struct("pos", "y"))["y"].alias("y_first")
    )
    layout = overall.join(summary, keys).join(revisited, keys).join(axes, keys)
    # Each run is compared with the place an ideal scan would give it.  The run
    # must begin at a multiple of the repeats, which also fixes its length.
    placed = attach_by_key(runs, layout, keys)
    repeats = F.col("n") / F.col("runs")
    row, column = F.floor(F.col("pos") / F.col("n_x")), F.col("pos") % F.col("n_x")
    ideal_x = F.col("low_x") + column * F.col("step_x")
    up = F.col("low_y") + row * F.coalesce(F.col("step_y"), F.lit(0.0))
    down = F.col("high_y") - row * F.coalesce(F.col("step_y"), F.lit(0.0))
    far = lambda a, b: F.coalesce(F.abs(a - b) > 2 * TOLERANCE_CM, F.lit(True))
    misfit = placed.groupBy(*keys).agg(
        F.max((F.col("shotnum") - F.col("first") != F.col("pos") * repeats)).alias("uneven"),
        F.max(far(F.col("x"), ideal_x)).alias("off_x"),
        F.max(far(F.col("y"), up)).alias("off_up"),
        F.max(far(F.col("y"), down)).alias("off_down"),
    )
    done = layout.join(misfit, keys)
    return done.select(
        *keys,
        _violation(plane).alias("violation"),
        *[
            F.when(_violation(plane).isNull(), value).alias(name)
            for name, value in _layout_columns(plane).items()
        ],
    )


def _axis(runs: DataFrame, axis: str) -> DataFrame:
    """Distinct coordinates of one axis: count, ends and whether the spacing is even."""
    values = runs.select("config", axis).distinct()
    w = Window.partitionBy("config").orderBy(axis)
    stepped = values.withColumn("_step", F.col(axis) - F.lag(axis).over(w))
    return stepped.groupBy("config").agg(
        F.count(F.lit(1)).alias(f"n_{axis}"), F.min(axis).alias(f"low_{axis}"),
        F.max(axis).alias(f"high_{axis}"),
        F.try_divide(F.max(axis) - F.min(axis), F.count(F.lit(1)) - 1).alias(f"step_{axis}"),
        (F.max("_step") - F.min("_step")).alias(f"wobble_{axis}"),
    )


def _violation(plane: bool) -> Column:
    c = F.col
    first = (
        F.when(c("n") < 2, "at least two scan shots are required")
        .when(
            (c("first") <= 0) | (c("nd") != c("n"))
            | (c("last_shot") - c("first") + 1 != c("n")),
            "shots must be positive and contiguous",
        )
        .when(c("nx_set") != c("n"), "x targets must be finite")
    )
    if plane:
        first = first.when(c("ny_set") != c("n"), "y targets must be finite")
    else:
        first = first.when(
            F.coalesce(c("y_spread") > TOLERANCE_CM, F.lit(False)), "targets vary in y"
        )
    first = first.when(c("uneven"), "repeats per position are not constant").when(
        c("visits") > 1, "a position is revisited"
    )
    if not plane:
        return first.when(c("runs") < 2, "x targets must increase").when(
            F.coalesce(c("wobble_x") > 2 * TOLERANCE_CM, F.lit(False)), "x targets must be evenly spaced"
        ).when(c("off_x"), "x targets must increase")
    return (
        first.when((c("n_x") < 2) | (c("n_y") < 2), "two x and two y positions are required")
        .when(
            (c("wobble_x") > 2 * TOLERANCE_CM) | (c("wobble_y") > 2 * TOLERANCE_CM),
            "targets must be evenly spaced along each axis",
        )
        .when(
            (c("runs") != c("n_x") * c("n_y")) | c("off_x") | (c("off_up") & c("off_down")),
            "targets must form a complete ordered rectangle",
        )
    )


def _layout_columns(plane: bool) -> dict[str, Column]:
    c = F.col
    columns = {
        "nshots": (c("n") / c("runs")).cast("bigint"), "data_offset": (c("first") - 1).cast("bigint"),
        "nx": c("n_x"), "x_min_cm": c("low_x"), "x_max_cm": c("high_x"),
    }
    if plane:
        columns |= {
            "ny": c("n_y"), "y_min_cm": c("low_y"), "y_max_cm": c("high_y"),
            "y_order": F.when(c("off_up"), "descending").otherwise("ascending"),
        }
    return columns
