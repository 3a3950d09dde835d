"""Cleaning of profiles along x and of maps in x and y, independently per ramp.

Lines use windows over the position index of one (run, ramp); a range frame
counts index neighbours, so absent positions need no filler rows.  Maps use a
stencil: every cell sends its value to the cells around it and each cell
aggregates what it received, so the work spreads over cells, not over maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import median
from ..functions.text import X

FIELDS = ("te_eV", "vp_V", "vf_V", "ies_A", "iis_A", "n_e_m3")


def _line(by: Sequence[str], order: str = "ix"):
    return Window.partitionBy(*by).orderBy(order)


# --- G1, G2, G3 ----------------------------------------------------------------------


def flag_line_spikes(
    line: DataFrame, value: str, by: Sequence[str], half_window: int = 2, threshold: float = 5.0,
    out: str = "spike",
) -> DataFrame:
    """G1: flags values farther than ``threshold`` from the median of their neighbours.

    The point itself is left out and at least two neighbours are needed.
    """
    w = _line(by)
    around = F.concat(
        F.collect_list(value).over(w.rangeBetween(-half_window, -1)),
        F.collect_list(value).over(w.rangeBetween(1, half_window)),
    )
    listed = line.withColumn("_near", around)
    far = F.abs(F.col(value) - median(X.col("_near")).column()) > threshold
    return listed.withColumn(
        out, F.coalesce((F.size("_near") >= 2) & far, F.lit(False))
    ).drop("_near")


def replace_line_spikes(
    line: DataFrame, value: str, flag: str, by: Sequence[str], x: str = "x_cm", out: str | None = None
) -> DataFrame:
    """Replaces flagged values by interpolation in x between unflagged ones.

    Ends are clamped; with fewer than two unflagged values nothing changes.
    """
    w = _line(by)
    good = F.when(F.col(value).isNotNull() & ~F.col(flag), F.struct(F.col(x).alias("x"), F.col(value).alias("y")))
    marked = line.withColumn("_good", good).withColumns(
        {
            "_prev": F.last("_good", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_next": F.first("_good", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
            "_n": F.count("_good").over(Window.partitionBy(*by)),
        }
    )
    p, q = F.col("_prev"), F.col("_next")
    between = p["y"] + (F.col(x) - p["x"]) * (q["y"] - p["y"]) / (q["x"] - p["x"])
    filled = F.when(p.isNull(), q["y"]).when(q.isNull(), p["y"]).otherwise(between)
    result = F.when(
        F.col(flag) & F.col(value).isNotNull() & (F.col("_n") >= 2), filled
    ).otherwise(F.col(value))
    return marked.withColumn(out or value, result).drop("_good", "_prev", "_next", "_n")


def smooth_line(
    line: DataFrame, values: dict[str, str], by: Sequence[str], half_window: int = 1,
    sigma: float = 1.0,
) -> DataFrame:
    """Gaussian-weighted mean over index neighbours that exist; missing stays missing."""
    near = _line(by).rangeBetween(-half_window, half_window)
    listed = line.withColumn(
        "_near",
        F.collect_list(F.struct("ix", *values)).over(near),
    )

    def mean_of(name: str) -> Column:
        top = F.lit(0.0)
        weight = lambda r: F.exp(-0.5 * F.pow((r["ix"] - F.col("ix")) / float(sigma), F.lit(2.0)))
        present = F.filter("_near", lambda r: r[name].isNotNull())
        total = F.aggregate(present, top, lambda acc, r: acc + weight(r) * r[name])
        norm = F.aggregate(present, top, lambda acc, r: acc + weight(r))
        return F.when(F.col(name).isNotNull(), total / norm)

    return listed.withColumns({out: mean_of(name) for name, out in values.items()}).drop("_near")


# --- G4 ------------------------------------------------------------------------------


def process_line(
    profiles: DataFrame,
    by: Sequence[str],
    fields: Sequence[str] = FIELDS,
    reject: bool = True,
    spike_half_window: int = 2,
    threshold: float = 5.0,
    replace: bool = True,
    smooth: bool = True,
    smooth_half_window: int = 1,
    sigma: float = 1.0,
) -> DataFrame:
    """Adds ``<field>_processed`` and ``vp_spike``; the input columns are the raw version."""
    out = profiles.withColumn("vp_clean", F.col("vp_V")).withColumn("vp_spike", F.lit(False))
    if reject:
        out = flag_line_spikes(out, "vp_V", by, spike_half_window, threshold, "vp_spike")
        if replace:
            out = replace_line_spikes(out, "vp_V", "vp_spike", by, out="vp_clean")
    sources = {("vp_clean" if f == "vp_V" else f): f"{f}_processed" for f in fields}
    if smooth:
        out = smooth_line(out, sources, by, smooth_half_window, sigma)
    else:
        out = out.withColumns({o: F.col(s) for s, o in sources.items()})
    return out.drop("vp_clean")


# --- G5, G6, G7 ----------------------------------------------------------------------


def half_windows(half_window: int | tuple[int, int]) -> tuple[int, int]:
    if isinstance(half_window, int):
        return half_window, half_window
    if len(half_window) != 2:
        raise ValueError("half_window must be a number or a (y, x) pair.")
    return int(half_window[0]), int(half_window[1])


def _stencil(cells: DataFrame, half_window: int | tuple[int, int]) -> DataFrame:
    """Every cell once per neighbour: (iy, ix) become the neighbour's, (dy, dx) the offset."""
    hy, hx = half_windows(half_window)
    offsets = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
            for dy in range(-hy, hy + 1)
            for dx in range(-hx, hx + 1)
        ]
    )
    spread = cells.withColumn("_o", F.explode(offsets))
    return (
        spread.withColumns(
            {
                "iy": F.col("iy") + F.col("_o.dy"), "ix": F.col("ix") + F.col("_o.dx"),
                "dy": F.col("_o.dy"), "dx": F.col("_o.dx"),
                "_self": (F.col("_o.dy") == 0) & (F.col("_o.dx") == 0),
            }
        ).drop("_o")
    )


def _own(column: str) -> Column:
    return F.max(F.when(F.col("_self"), F.col(column)))


def _carried(cells: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in cells.columns if c not in (*by, "iy", "ix")]


def flag_map_spikes(
    cells: DataFrame, value: str, by: Sequence[str],
    half_window: int | tuple[int, int] = (1, 1), threshold: float = 5.0, out: str = "spike",
) -> DataFrame:
    """Flags cells farther than ``threshold`` from the median of their neighbours."""
    sent = _stencil(cells, half_window)
    other = F.when(~F.col("_self"), F.col(value))
    received = sent.groupBy(*by, "iy", "ix").agg(
        F.bool_or("_self").alias("_here"), F.percentile(other, F.lit(0.5)).alias("_med"),
        F.count(other).alias("_n"), *[_own(c).alias(c) for c in _carried(cells, by)],
    )
    flagged = F.coalesce(
        (F.col("_n") >= 2) & (F.abs(F.col(value) - F.col("_med")) > threshold), F.lit(False)
    )
    return received.where("_here").withColumn(out, flagged).drop("_here", "_med", "_n")


def replace_map_spikes(
    cells: DataFrame, value: str, flag: str, by: Sequence[str],
    half_window: int | tuple[int, int] = (1, 1), out: str | None = None,
) -> DataFrame:
    """Replaces flagged cells by the median of unflagged neighbours, if there are any."""
    sent = _stencil(cells, half_window)
    usable = F.when(~F.col(flag), F.col(value))
    received = sent.groupBy(*by, "iy", "ix").agg(
        F.bool_or("_self").alias("_here"), F.percentile(usable, F.lit(0.5)).alias("_med"),
        *[_own(c).alias(c) for c in _carried(cells, by)],
    )
    filled = F.when(
        F.col(flag) & F.col(value).isNotNull(), F.coalesce("_med", F.col(value))
    ).otherwise(F.col(value))
    return received.where("_here").withColumn(out or value, filled).drop("_here", "_med")


def smooth_map(
    cells: DataFrame, values: dict[str, str], by: Sequence[str],
    half_window: int | tuple[int, int] = (1, 1), sigma: float = 1.0,
) -> DataFrame:
    """Gaussian-weighted mean over present neighbours; all fields share one stencil."""
    sent = _stencil(cells, half_window)
    square = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    weight = F.exp(square * (-0.5 / float(sigma) ** 2))
    measures: list[Column] = []
    for name in values:
        present = F.col(name).isNotNull()
        measures += [
            F.sum(weight * F.col(name)).alias(f"_t_{name}"),
            F.sum(F.when(present, weight)).alias(f"_w_{name}"),
        ]
    received = sent.groupBy(*by, "iy", "ix").agg(
        F.bool_or("_self").alias("_here"), *measures,
        *[_own(c).alias(c) for c in _carried(cells, by)],
    )
    result = received.where("_here").withColumns(
        {
            out: F.when(F.col(name).isNotNull(), F.col(f"_t_{name}") / F.col(f"_w_{name}"))
            for name, out in values.items()
        }
    )
    return result.drop("_here", *[f"_{k}_{n}" for n in values for k in "tw"])


# --- G8, G9 --------------------------------------------------------------------------


def process_map(
    profiles: DataFrame,
    by: Sequence[str],
    fields: Sequence[str] = FIELDS,
    reject: bool = True,
    spike_half_window: int | tuple[int, int] = (1, 1),
    threshold: float = 5.0,
    replace: bool = True,
    smooth: bool = True,
    smooth_half_window: int | tuple[int, int] = (1, 1),
    sigma: float = 1.0,
) -> DataFrame:
    """As :func:`process_line` on maps."""
    out = profiles.withColumn("vp_clean", F.col("vp_V")).withColumn("vp_spike", F.lit(False))
    if reject:
        out = flag_map_spikes(out, "vp_V", by, spike_half_window, threshold, "vp_spike")
        if replace:
            out = replace_map_spikes(out, "vp_V", "vp_spike", by, spike_half_window, "vp_clean")
    sources = {("vp_clean" if f == "vp_V" else f): f"{f}_processed" for f in fields}
    if smooth:
        out = smooth_map(out, sources, by, smooth_half_window, sigma)
    else:
        out = out.withColumns({o: F.col(s) for s, o in sources.items()})
    return out.drop("vp_clean")


def reported_version(
    processed: DataFrame, reject: bool, smooth: bool, fields: Sequence[str] = FIELDS
) -> DataFrame:
    """Renames the inputs to ``<field>_raw`` and puts the reported version in ``<field>``.

    Processed when smoothing is on; Vp also when spike rejection is on.
    """
    out = processed.withColumnsRenamed({f: f"{f}_raw" for f in fields})
    return out.withColumns(
        {
            f: F.col(f"{f}_processed" if smooth or (reject and f == "vp_V") else f"{f}_raw")
            for f in fields
        }
    )
