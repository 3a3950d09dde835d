"""Direction and voltage bins of the traces of a batch."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..functions.batches import as_lists, lists, medians, places, steps
from ..params import MAX_REVERSE_SWEEP_FRACTION, MIN_CURVE_POINTS

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = "struct<vb:array<double>,ib:array<double>>"
GRIDS = "struct<va:array<double>,ia:array<double>,vg:array<double>,ig:array<double>>"
DIRECTION_BLOCKS = 25


def one_way(v: pa.Array, width: float) -> pa.Array:
    """Whether each trace's voltage moves in one dominant direction; missing samples are passed over."""
    starts, lengths, values = lists(v)
    row, place = places(starts, lengths)
    kept = np.isfinite(values[place])
    row, samples = row[kept], values[place][kept]
    counts = np.bincount(row, minlength=len(v))
    first = np.cumsum(counts) - counts
    out = np.zeros(len(v), bool)
    for n in np.unique(counts[counts >= MIN_CURVE_POINTS]).tolist():
        rows = np.flatnonzero(counts == n)
        s = samples[first[rows][:, None] + np.arange(n)]
        span = s.max(1) - s.min(1)
        medians = np.stack([np.median(part, 1) for part in np.array_split(s, min(DIRECTION_BLOCKS, n // 3), 1)], 1)
        steps = np.diff(medians, axis=1)
        large = np.where(np.abs(steps) >= np.maximum(width, 0.01 * span)[:, None], steps, 0.0)
        back = np.minimum(np.where(large > 0, large, 0.0).sum(1), -np.where(large < 0, large, 0.0).sum(1))
        out[rows] = (span >= (MIN_CURVE_POINTS - 1) * width) & (large != 0).any(1) & (back <= MAX_REVERSE_SWEEP_FRACTION * span)
    return pa.array(out)


def _by_voltage(row: np.ndarray, vs: np.ndarray, cs: np.ndarray) -> np.ndarray:
    """The order by voltage and then current inside every row; rows are consecutive."""
    # a sweep is nearly in order, which a stable sort of one trace makes use of
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    order = np.empty(len(row), np.int64)
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(row)], strict=False):
        part = np.argsort(vs[a:b], kind="stable")
        ordered = vs[a:b][part]
        if (ordered[1:] == ordered[:-1]).any():
            part = np.lexsort((cs[a:b], vs[a:b]))
        order[a:b] = part + a
    return order


def bin_means(v: pa.Array, i: pa.Array, width: float) -> pa.Array:
    """struct(vb, ib) of every trace: means of voltage bins, increasing; NULLs with fewer than two bins.

    Samples that miss a value are left out. Arrays of different length are an error.
    """
    (starts, lengths, vs), (starts_i, lengths_i, cs) = lists(v), lists(i)
    if v.null_count or i.null_count or (lengths != lengths_i).any():
        raise ValueError("V and I must have the same length.")
    row, place = places(starts, lengths)
    vs, cs = vs[place], cs[places(starts_i, lengths_i)[1]]
    kept = np.isfinite(vs) & np.isfinite(cs)
    row, vs, cs = row[kept], vs[kept], cs[kept]
    order = _by_voltage(row, vs, cs)
    vs, cs = vs[order], cs[order]
    if len(row):
        new_row = np.concatenate([[True], row[1:] != row[:-1]])
        lowest = vs[new_row][np.cumsum(new_row) - 1]
        number = np.floor((vs - lowest) / width)
        begin = np.flatnonzero(new_row | np.concatenate([[True], number[1:] != number[:-1]]))
        size = np.diff(np.concatenate([begin, [len(row)]]))
        vb, ib, row = np.add.reduceat(vs, begin) / size, np.add.reduceat(cs, begin) / size, row[begin]
        rises = new_row[begin] | np.concatenate([[True], vb[1:] > vb[:-1]])
        vb, ib, row = vb[rises], ib[rises], row[rises]
    else:
        vb = ib = vs
    counts = np.bincount(row, minlength=len(v))
    enough = counts >= 2
    inside = enough[row]
    bins = [as_lists(b[inside], np.where(enough, counts, 0), ~enough) for b in (vb, ib)]
    return pa.StructArray.from_arrays(bins, names=["vb", "ib"])


def on_even_points(x: np.ndarray, y: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` even points over the span of every curve, both ends exact, and the piecewise line there.

    A curve has ``size`` consecutive nodes; each segment gives the points that it covers.
    """
    end = np.cumsum(size)
    row, node = np.repeat(np.arange(len(size)), size), np.arange(len(x))
    x0, x1 = x[end - size], x[end - 1]
    step = (x1 - x0) / (n - 1)
    begins = np.ceil((x - x0[row]) / step[row]).astype(np.int64)
    begins[end - size], begins[end - 1] = 0, n - 1
    segment = np.flatnonzero(node != (end - 1)[row])
    lo, hi = begins[segment], np.minimum(begins[segment + 1], (n - 1)[row[segment]])
    counts = np.maximum(hi - lo, 0)
    slope = (y[segment + 1] - y[segment]) / (x[segment + 1] - x[segment])
    of, j = places(lo, counts)
    at, r = segment[of], row[segment[of]]
    points = x0[r] + j * step[r]
    last = np.cumsum(n) - 1
    grid, values = np.empty(n.sum()), np.empty(n.sum())
    inner = np.ones(len(grid), bool)
    inner[last] = False
    grid[inner], values[inner] = points, y[at] + (points - x[at]) * slope[of]
    grid[last], values[last] = x1, y[end - 1]
    return grid, values


def even_grids(vb: pa.Array, ib: pa.Array, points: int, width: float) -> pa.Array:
    """struct(va, ia, vg, ig): the analysis grid and a grid of ``points``; NULLs with fewer than seven bins."""
    (starts, lengths, vs), (starts_i, lengths_i, cs) = lists(vb), lists(ib)
    enough = lengths >= MIN_CURVE_POINTS
    if (lengths != lengths_i)[enough].any():
        raise ValueError("V and I must have the same length.")
    size = lengths[enough]
    x, y = vs[places(starts[enough], size)[1]], cs[places(starts_i[enough], size)[1]]
    columns = []
    if len(size):
        end = np.cumsum(size)
        spacing = np.maximum(medians(steps(x, size), size - 1), 0.5 * width)
        fine = np.maximum(MIN_CURVE_POINTS, np.ceil((x[end - 1] - x[end - size]) / spacing).astype(np.int64) + 1)
        fine = np.minimum(np.maximum(4 * size, MIN_CURVE_POINTS), fine)
    else:
        fine = size
    for n in (fine, np.full(len(size), points)):
        full = np.zeros(len(lengths), np.int64)
        full[enough] = n
        columns += [as_lists(values, full, ~enough) for values in (on_even_points(x, y, size, n) if len(size) else (x, y))]
    return pa.StructArray.from_arrays(columns, names=["va", "ia", "vg", "ig"])
