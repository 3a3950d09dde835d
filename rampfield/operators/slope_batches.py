"""Slopes of the curves of a batch by local polynomials."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..functions.batches import as_lists, lists, medians, places, steps
from ..functions.kernels import basis_values
from ..params import MIN_CURVE_POINTS

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOPE = "struct<didv:array<double>,edge:int>"


def per_sample(y: np.ndarray, size: np.ndarray, w: int, order: int) -> np.ndarray:
    """Slope of the polynomial over an odd window ``w`` at every sample of consecutive curves.

    The first and last ``w // 2`` samples use the polynomial of the edge window.
    """
    h, end = w // 2, np.cumsum(size)
    t = np.arange(w) - (w - 1) / 2
    values, slopes, norms = basis_values(t, w, order)
    terms = [slope / norm for slope, norm in zip(slopes, norms, strict=True)]
    # the middle of the window is its sample h
    kernel = sum((terms[k][h] * values[k] for k in range(1, order + 1)), terms[0][h] * values[0])
    out = np.empty(len(y))
    inner = places(end - size + h, size - 2 * h)[1]
    out[inner] = sum((y[inner - h + j] * kernel[j] for j in range(w)), 0.0)
    for begin, first in ((end - size, 0), (end - w, w - h)):
        parts = [sum((y[begin + j] * values[k][j] for j in range(w)), 0.0) for k in range(order + 1)]
        for j in range(first, first + h):
            out[begin + j] = sum((parts[k] * terms[k][j] for k in range(1, order + 1)), parts[0] * terms[0][j])
    return out


def smooth_slope(v: pa.Array, i: pa.Array, width: float, order: int) -> pa.Array:
    """struct(didv, edge) of every curve; NULL with fewer than seven points, ``didv`` NULL where the window holds too few."""
    (starts, lengths, vs), (starts_i, lengths_i, cs) = lists(v), lists(i)
    enough = lengths >= MIN_CURVE_POINTS
    if (lengths != lengths_i)[enough].any():
        raise ValueError("V and I must have the same length.")
    size, window, step = lengths[enough], np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
    if len(size):
        step[enough] = medians(steps(vs[places(starts[enough], size)[1]], size), size - 1)
        points = np.maximum(1, np.rint(width / step[enough]).astype(np.int64))
        smallest = order + 2 if order % 2 else order + 3
        window[enough] = np.minimum(np.maximum(points + (1 - points % 2), smallest), size - (1 - size % 2))
    fitted = enough & (window > order)
    counts = np.where(fitted, lengths, 0)
    begin, flat = np.cumsum(counts) - counts, np.empty(counts.sum())
    for w in np.unique(window[fitted]).tolist():
        rows = np.flatnonzero(fitted & (window == w))
        row, place = places(starts_i[rows], lengths[rows])
        flat[places(begin[rows], lengths[rows])[1]] = per_sample(cs[place], lengths[rows], w, order) / step[rows][row]
    edges = pa.array(np.maximum(1, window // 2).astype(np.int32))
    return pa.StructArray.from_arrays([as_lists(flat, counts, ~fitted), edges], names=["didv", "edge"], mask=pa.array(~enough))
