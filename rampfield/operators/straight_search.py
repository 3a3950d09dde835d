"""The search for the broadest straight interval, the traces of a batch at a time.

Every interval has prefix power sums, so a candidate is judged by differences of these.
The candidates of all traces are the elements of flat arrays; the rule and its order are
those of :func:`.temperature.linear_region`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..functions.batches import lists, places
from ..params import TE_MAX_BLOCK_DEVIATION_LOG, TE_MAX_CURVATURE_LOG, TE_MAX_RELATIVE_SLOPE_ERROR, TE_MIN_LOG_SPAN

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEARCH_EDGES = 33
REFINE_EDGES = 9
BLOCKS = 8
#: intervals whose candidates are judged together
AT_ONCE = 256
FOUND = "struct<start:int,stop:int,candidates:int>"


def _ratio(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The quotient, NaN where the divisor is zero."""
    return np.divide(above, below, out=np.full(np.shape(below), np.nan), where=below != 0)


def even_edges(lo: np.ndarray, hi: np.ndarray, pieces: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of an even division of [lo, hi], a row each, and which of them are there and new."""
    j = np.arange(most + 1)
    lo, hi, pieces = lo[:, None], hi[:, None], pieces[:, None]
    edges = np.where(j >= pieces, hi, np.floor(j * ((hi - lo) / pieces) + lo).astype(np.int64))
    new = j <= pieces
    new[:, 1:] &= edges[:, 1:] != edges[:, :-1]
    return edges, new


class Intervals:
    """Intervals [start, stop) of bins of their traces, with prefix sums in positions scaled to [-1, 1]."""

    def __init__(self, trace: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray, v: np.ndarray, i: np.ndarray, ion: np.ndarray) -> None:
        self.trace, self.start, self.stop, self.v, self.first = trace, start, stop, v, first
        size = stop - start
        row, place = places(first + start, size)
        low, high = v[first + start], v[first + stop - 1]
        x = (2 * v[place] - high[row] - low[row]) / np.maximum(high - low, 1e-300)[row]
        y = np.log(i[place] - ion[row])
        powers = np.stack([x, y, x**2, x * y, y**2, x**3, x**4, x * x * y])
        # one place more for each interval, as its sums begin with zero
        end = np.cumsum(size)
        begin, self.zero = end - size, end - size + np.arange(len(size))
        self.x, self.begin = x, begin
        self.sums = np.zeros((len(powers), len(x) + len(size)))
        for a, b, zero in zip(begin.tolist(), end.tolist(), self.zero.tolist(), strict=True):
            np.cumsum(powers[:, a:b], axis=1, out=self.sums[:, zero + 1 : zero + 1 + b - a])

    def straight(self, iv: np.ndarray, a: np.ndarray, b: np.ndarray, min_r2: float) -> np.ndarray:
        """Linearity of bins [a, b) of each interval ``iv``."""
        a, b = a - self.start[iv], b - self.start[iv]
        zero = self.zero[iv]
        n = (b - a).astype(float)
        sx, sy, sxx, sxy, syy, sx3, sx4, sx2y = self.sums[:, zero + b] - self.sums[:, zero + a]
        u, w = sx / n, sy / n
        m2 = sxx - n * u * u
        m3 = sx3 - 3 * u * sxx + 2 * n * u * u * u
        m4 = sx4 - 4 * u * sx3 + 6 * u * u * sxx - 3 * n * u * u * u * u
        c2y = sx2y - 2 * u * sxy + u * u * sy - w * m2
        cxy, cyy = sxy - n * u * w, syy - n * w * w
        slope = _ratio(cxy, m2)
        span = self.x[self.begin[iv] + b - 1] - self.x[self.begin[iv] + a]
        ss_res = np.maximum(0.0, cyy - slope * cxy)
        q = _ratio(c2y - _ratio(m3, m2) * cxy, m4 - _ratio(m3 * m3, m2) - m2 * m2 / n)
        good = (
            (slope * span >= TE_MIN_LOG_SPAN) & (cyy > 0) & (1.0 - _ratio(ss_res, cyy) >= min_r2)
            & (np.sqrt(_ratio(ss_res / np.maximum(1.0, n - 2), m2)) <= TE_MAX_RELATIVE_SLOPE_ERROR * slope)
            & (n >= 5) & (np.abs(q) * span * span <= TE_MAX_CURVATURE_LOG)
        )
        # blocks only of what passed so far
        left = np.flatnonzero(good)
        count = (b - a)[left]
        parts = np.maximum(1, np.minimum(BLOCKS, count // 3))
        base, whole, extra = (zero + a)[left], count // parts, count % parts
        for block in range(BLOCKS):
            k = np.minimum(block, parts - 1)
            lo, hi = base + k * whole + np.minimum(k, extra), base + (k + 1) * whole + np.minimum(k + 1, extra)
            mean_x, mean_y = (self.sums[:2, hi] - self.sums[:2, lo]) / (hi - lo)
            deviation = np.abs(mean_y - w[left] - slope[left] * (mean_x - u[left]))
            good[left] &= deviation <= TE_MAX_BLOCK_DEVIATION_LOG
        return good

    def first_straight(
        self, iv: np.ndarray, a: np.ndarray, b: np.ndarray, min_r2: float
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates in order (trace, widest first, start, stop), which were judged and which were the first to pass."""
        trace = self.trace[iv]
        negative = self.v[self.first[iv] + a] - self.v[self.first[iv] + b - 1]
        order = np.lexsort((iv, b, a, negative, trace))
        good = self.straight(iv[order], a[order], b[order], min_r2)
        # candidates of the same trace that passed before
        begin = np.flatnonzero(np.diff(trace[order], prepend=-1))
        passed = np.cumsum(good) - good
        before = passed - np.repeat(passed[begin], np.diff(np.append(begin, len(good))))
        return order, before == 0, good & (before == 0)


def _search(all_: Intervals, least: int, min_r2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per trace with a straight interval: (trace, start, stop); and the (trace, key) of all that were judged."""
    ready = np.flatnonzero(all_.stop - all_.start >= least)
    edges, there = even_edges(all_.start[ready], all_.stop[ready], np.minimum(SEARCH_EDGES - 1, (all_.stop - all_.start)[ready]), SEARCH_EDGES - 1)
    row, j, k = np.nonzero(there[:, :, None] & there[:, None, :] & (edges[:, None, :] - edges[:, :, None] >= least))
    iv, a, b = ready[row], edges[row, j], edges[row, k]
    order, judged, hit = all_.first_straight(iv, a, b, min_r2)
    seen = [(all_.trace[iv[order[judged]]], a[order[judged]], b[order[judged]])]
    iv, a, b = iv[order[hit]], a[order[hit]], b[order[hit]]

    step = np.maximum(1, -(-(all_.stop - all_.start)[iv] // 32))
    left = np.arange(len(iv))
    while len(left):
        home, at_a, at_b, by = iv[left], a[left], b[left], step[left]
        pieces = np.full(len(left), REFINE_EDGES - 1)
        starts, there_a = even_edges(np.maximum(all_.start[home], at_a - by), np.minimum(at_b - least, at_a + by), pieces, REFINE_EDGES - 1)
        stops, there_b = even_edges(np.maximum(at_a + least, at_b - by), np.minimum(all_.stop[home], at_b + by), pieces, REFINE_EDGES - 1)
        v, first = all_.v, all_.first[home]
        wide = v[first[:, None] + stops - 1][:, None, :] - v[first[:, None] + starts][:, :, None]
        enough = wide >= (v[first + at_b - 1] - v[first + at_a])[:, None, None]
        row, j, k = np.nonzero(there_a[:, :, None] & there_b[:, None, :] & (stops[:, None, :] - starts[:, :, None] >= least) & enough)
        ca, cb = starts[row, j], stops[row, k]
        order, judged, hit = all_.first_straight(home[row], ca, cb, min_r2)
        seen.append((all_.trace[home[row[order[judged]]]], ca[order[judged]], cb[order[judged]]))
        better = order[hit]
        a[left[row[better]]], b[left[row[better]]] = ca[better], cb[better]
        left = left[by > 1]
        step[left] = np.maximum(1, step[left] // 4)
    traces, lows, highs = (np.concatenate(part) for part in zip(*seen, strict=True))
    return all_.trace[iv], a, b, traces, lows * 16777216 + highs


def _some(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of traces that hold about AT_ONCE intervals."""
    share = np.cumsum(counts) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(counts)]
    return ((x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y > x)


def broadest_straight(
    v: pa.Array, i: pa.Array, starts: pa.Array, stops: pa.Array, seed_start: pa.Array, seed_stop: pa.Array, ion: pa.Array,
    least: int, min_r2: float,
) -> pa.Array:
    """struct(start, stop, candidates) of every trace; start and stop are NULL where no interval is straight.

    ``starts, stops`` are the trace's intervals of bins, the seed the one that counts as judged in any case.
    """
    (first, _, vs), (first_i, _, cs), (where, counts, low), (where_b, _, high) = lists(v), lists(i), lists(starts), lists(stops)
    # currents begin where voltages do
    if len(v) and (first != first_i).any():
        raise ValueError("V and I must have the same length.")
    number = lambda column, none: column.fill_null(none).to_numpy(zero_copy_only=False)
    seeds = number(seed_start, -1).astype(np.int64) * 16777216 + number(seed_stop, 0)
    currents = number(ion, float("nan"))
    found, judged = np.full((2, len(v)), -1, np.int64), np.zeros(len(v), np.int64)
    for x, y in _some(counts):
        row, place = places(where[x:y], counts[x:y])
        row_b = places(where_b[x:y], counts[x:y])[1]
        row = row + x
        with np.errstate(all="ignore"):
            some = Intervals(row, low[place].astype(np.int64), high[row_b].astype(np.int64), first[row], vs, cs, currents[row])
            traces, a, b, seen, keys = _search(some, least, min_r2)
        found[0, traces], found[1, traces] = a, b
        seeded = np.arange(x, y)[seeds[x:y] >= 0]
        seen, keys = np.concatenate([seen, seeded]), np.concatenate([keys, seeds[seeded]])
        order = np.lexsort((keys, seen))
        new = (np.diff(seen[order], prepend=-1) != 0) | (np.diff(keys[order], prepend=-1) != 0)
        judged += np.bincount(seen[order[new]], minlength=len(v))
    absent = found[0] < 0
    columns = [pa.array(values.astype(np.int32), mask=absent) for values in found]
    return pa.StructArray.from_arrays([*columns, pa.array(judged.astype(np.int32))], names=["start", "stop", "candidates"])
