"""The exponential fit of background windows, many windows of a batch at a time.

Windows of like length are the rows of one array, filled up to the longest with zero
weight. The model and its notation are those of :mod:`.background`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..functions.batches import lists, medians, places, steps
from ..params import (
    MIN_CURVE_POINTS, SIGNAL_TO_NOISE, TE_MAX_BLOCK_DEVIATION_LOG, TE_MAX_RELATIVE_SLOPE_ERROR, TE_MIN_LOG_SPAN,
)

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = 49
NARROW_POINTS = 9
NARROW_ROUNDS = 2
NEWTON_ROUNDS = 20
CONVERGED_LOG = 1e-13
BOUNDARY_LOG = 0.01
#: samples that are fitted together
AT_ONCE = 32_768

NUMBERS = (
    "te_eV", "te_relative_uncertainty", "amplitude_A", "background_at_vmax_A", "background_at_vmax_uncertainty_A",
    "background_slope_A_per_V", "rmse_A", "r2", "vstart_V", "vstop_V",
)
COMPONENTS = ("fitted_A", "exponential_A", "background_A")
FIT = (
    "struct<valid:boolean," + ",".join(f"{n}:double" for n in NUMBERS) + ","
    + ",".join(f"{n}:array<double>" for n in COMPONENTS) + ">"
)

SPANS = "array<struct<width:double,start:int,n:int>>"
CHECKS = "struct<ok:boolean,v0:double,v1:double>"
CHECK_BLOCKS = 8


def _ratio(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The quotient, NaN where the divisor is zero."""
    return np.divide(above, below, out=np.full(np.shape(below), np.nan), where=below != 0)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


class Windows:
    """Windows as rows: ``x = V - Vmax``, ``y`` the scaled current, ``w`` 1 where a sample is."""

    def __init__(self, v: np.ndarray, i: np.ndarray, n: np.ndarray) -> None:
        self.w = (np.arange(v.shape[1]) < n[:, None]).astype(float)
        top = v[np.arange(len(n)), n - 1]
        self.scale = i.max(1) - i.min(1)
        self.span = top - v[:, 0]
        self.x, self.y, self.n = (v - top[:, None]) * self.w, i / self.scale[:, None] * self.w, n.astype(float)
        self.mx, self.my = self.x.sum(1) / self.n, self.y.sum(1) / self.n
        self.dx, dy = (self.x - self.mx[:, None]) * self.w, (self.y - self.my[:, None]) * self.w
        self.cxx, self.cyy, self.cxy = _dot(self.dx, self.dx), _dot(dy, dy), _dot(self.dx, dy)

    def some(self, rows: np.ndarray) -> Windows:
        part = object.__new__(Windows)
        part.__dict__ = {name: value[rows] for name, value in self.__dict__.items()}
        return part

    def solve(self, log_t: np.ndarray) -> None:
        """Moments of e = exp(x / T), and the best amplitude and line at one temperature each."""
        self.rate = np.exp(-log_t)
        self.e = np.exp(self.x * self.rate[:, None]) * self.w
        total = self.e.sum(1)
        self.me = total / self.n
        self.cee = _dot(self.e, self.e) - total * total / self.n
        self.cex = _dot(self.e, self.x) - total * self.mx
        self.cey = _dot(self.e, self.y) - total * self.my
        self.a = _ratio(self.cey - self.cex * self.cxy / self.cxx, self.cee - self.cex * self.cex / self.cxx)
        self.d = (self.cxy - self.a * self.cex) / self.cxx
        self.c = self.my - self.a * self.me - self.d * self.mx

    def score(self, log_t: np.ndarray) -> np.ndarray:
        self.solve(log_t)
        rss = np.maximum(0.0, self.cyy - self.a * self.cey - self.d * self.cxy)
        return np.where(np.isnan(rss), self.cyy, rss)

    def best_of(self, points: np.ndarray) -> np.ndarray:
        """Of the points of every row that with the smallest residual, the first on a tie."""
        scores = np.stack([self.score(points[:, k]) for k in range(points.shape[1])], 1)
        return points[np.arange(len(points)), scores.argmin(1)]

    def directions(self) -> None:
        """Direction ``g`` of ln T, and the same cleaned of 1, x and e; residuals are explicit, so nothing cancels."""
        column = lambda value: value[:, None]
        self.g = -column(self.a * self.rate) * self.e * self.x
        self.r = (self.y - column(self.a) * self.e - column(self.d) * self.x - column(self.c)) * self.w
        de = (self.e - column(self.me)) * self.w
        self.mg = self.g.sum(1) / self.n
        cgx, cge = _dot(self.g, self.dx), _dot(self.g, de)
        ex = self.cex / self.cxx
        be = _ratio(cge - cgx * ex, self.cee - self.cex * ex)
        be = np.where(np.isnan(be), 0.0, be)
        pure = (self.g - column(self.mg) - column(cgx / self.cxx) * self.dx - column(be) * (de - column(ex) * self.dx)) * self.w
        self.gr, self.gg = _dot(pure, self.r), _dot(pure, pure)

    def search(self, low: float, high: float) -> np.ndarray:
        """ln T: a grid, narrowing around its best point, Gauss-Newton steps inside the bracket."""
        step, rows = (high - low) / (GRID - 1), len(self.n)
        near = self.best_of(np.broadcast_to(np.arange(GRID) * step + low, (rows, GRID)))
        lo, hi = np.maximum(low, near - step), np.minimum(high, near + step)
        for _ in range(NARROW_ROUNDS):
            gap = (hi - lo) / (NARROW_POINTS - 1)
            near = self.best_of(lo[:, None] + np.arange(NARROW_POINTS) * gap[:, None])
            lo, hi = np.maximum(lo, near - gap), np.minimum(hi, near + gap)
        log_t, left = (lo + hi) / 2, np.arange(rows)
        for _ in range(NEWTON_ROUNDS):
            part = self.some(left)
            part.solve(log_t[left])
            part.directions()
            move = _ratio(part.gr, part.gg)
            moved = np.clip(log_t[left] + np.where(np.isnan(move), 0.0, move), lo[left], hi[left])
            done = np.abs(moved - log_t[left]) <= CONVERGED_LOG
            log_t[left] = moved
            left = left[~done]
            if not len(left):
                break
        return log_t


def _described(s: Windows, log_t: np.ndarray, low: float, high: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Validity and numbers of the solutions; ``s`` is left solved."""
    s.solve(log_t)
    s.directions()
    dg = (s.g - s.mg[:, None]) * s.w
    # Elimination order x, e, g: pivots of the centred products, then the
    # intercept's variance 1/n + m' S^-1 m from the same pivots.
    lex, lgx = s.cex / s.cxx, _dot(dg, s.dx) / s.cxx
    pe, ge, pg, raw = s.cee - lex * s.cex, _dot(dg, s.e) - lgx * s.cex, s.gg, _dot(s.g, s.g)
    ue = s.me - lex * s.mx
    ug = s.mg - lgx * s.mx - _ratio(ge, pe) * ue
    ss = _dot(s.r, s.r)
    full_rank = (pg > 1e-22 * raw) & (pe > 1e-22 * s.cee) & (raw > 0)
    variance = np.where(full_rank, ss / (s.n - 4), np.nan)
    te = np.exp(log_t)
    relative = np.sqrt(variance * _ratio(np.ones_like(pg), pg))
    var_c = 1.0 / s.n + s.mx * s.mx / s.cxx + _ratio(ue * ue, pe) + _ratio(ug * ug, pg)
    edge = np.minimum(log_t - low, high - log_t) < BOUNDARY_LOG
    valid = full_rank & (s.a > 0) & ~edge & (s.span / te >= TE_MIN_LOG_SPAN) & (relative <= TE_MAX_RELATIVE_SLOPE_ERROR)
    return valid, {
        "te_eV": te, "te_relative_uncertainty": relative, "amplitude_A": s.a * s.scale, "background_at_vmax_A": s.c * s.scale,
        "background_at_vmax_uncertainty_A": np.sqrt(variance * var_c) * s.scale, "background_slope_A_per_V": s.d * s.scale,
        "rmse_A": np.sqrt(ss / s.n) * s.scale, "r2": 1.0 - ss / s.cyy,
    }


def _alike(lengths: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in parts of like length that hold about AT_ONCE samples."""
    rows = rows[np.argsort(lengths[rows], kind="stable")]
    start = 0
    while start < len(rows):
        stop = min(len(rows), start + max(1, AT_ONCE // int(lengths[rows[start]])))
        while stop > start + 1 and (stop - start) * lengths[rows[stop - 1]] > 2 * AT_ONCE:
            stop = start + (stop - start + 1) // 2
        yield rows[start:stop]
        start = stop


def fitted(wv: pa.Array, wi: pa.Array, low: float, high: float) -> pa.Array:
    """The fit of every window of a batch, NULL for windows that cannot be fitted."""
    (starts, lengths, v), (starts_i, lengths_i, i) = lists(wv), lists(wi)
    numbers, valid = {name: np.full(len(wv), np.nan) for name in NUMBERS}, np.zeros(len(wv), bool)
    parts = {}
    for rows in _alike(lengths, np.flatnonzero((lengths >= MIN_CURVE_POINTS) & (lengths == lengths_i))):
        n = lengths[rows]
        # places after the end repeat the last sample
        place = np.minimum(np.arange(n.max()), n[:, None] - 1)
        vs, cs = v[starts[rows][:, None] + place], i[starts_i[rows][:, None] + place]
        rises = (np.diff(vs, axis=1) > 0) | (place[:, 1:] == place[:, :-1])
        good = np.isfinite(vs).all(1) & np.isfinite(cs).all(1) & rises.all(1) & (cs.max(1) > cs.min(1))
        rows, n, vs, cs = rows[good], n[good], vs[good], cs[good]
        if not len(rows):
            continue
        s = Windows(vs, cs, n)
        with np.errstate(all="ignore"):
            log_t = s.search(low, high)
            valid[rows], found = _described(s, log_t, low, high)
        for name, values in {**found, "vstart_V": vs[:, 0], "vstop_V": vs[np.arange(len(n)), n - 1]}.items():
            numbers[name][rows] = values
        scale = s.scale[:, None]
        line = s.c[:, None] + s.d[:, None] * s.x
        parts.update(
            (row, (fit[:k], exponential[:k], background[:k]))
            for row, k, fit, exponential, background in zip(
                rows.tolist(), n.tolist(), (s.y - s.r) * scale, s.a[:, None] * s.e * scale, line * scale, strict=True
            )
        )
    held = sorted(parts)
    sizes = np.zeros(len(wv) + 1, np.int32)
    sizes[np.asarray(held, np.int64) + 1] = [len(parts[row][0]) for row in held]
    offsets = pa.array(np.cumsum(sizes, dtype=np.int32))

    def component(k: int) -> pa.Array:
        flat = np.concatenate([parts[row][k] for row in held]) if held else np.zeros(0)
        return pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))

    columns = [pa.array(valid)] + [pa.array(numbers[name], mask=~np.isfinite(numbers[name])) for name in NUMBERS]
    absent = np.ones(len(wv), bool)
    absent[held] = False
    return pa.StructArray.from_arrays(
        columns + [component(k) for k in range(len(COMPONENTS))], names=["valid", *NUMBERS, *COMPONENTS], mask=pa.array(absent)
    )


def nested_spans(vb: pa.Array, upper: pa.Array, widths: tuple[float, ...], least: int) -> pa.Array:
    """Per trace the windows that end at ``upper``: (width, first bin, bins) of those it covers with ``least`` bins."""
    starts, lengths, v = lists(vb)
    top = upper.to_numpy(zero_copy_only=False)
    some = np.flatnonzero((lengths >= 2) & np.isfinite(top))
    size, width = lengths[some], np.asarray(widths, float)
    step = medians(steps(v[places(starts[some], size)[1]], size), size - 1) if len(some) else top[some]
    counts, parts = np.zeros(len(lengths) + 1, np.int32), []
    for row, begin, n, dv in zip(some.tolist(), starts[some].tolist(), size.tolist(), step.tolist(), strict=True):
        bins, end = v[begin : begin + n], top[row]
        first, stop = np.searchsorted(bins, end - width), np.searchsorted(bins, end, "right")
        kept = (bins[0] <= end - width + dv) & (stop - first >= least)
        counts[row + 1] = kept.sum()
        parts.append((width[kept], first[kept], stop - first[kept]))
    flat = [np.concatenate(part) for part in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 3
    fields = [pa.array(flat[0]), *(pa.array(part.astype(np.int32)) for part in flat[1:])]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.StructArray.from_arrays(fields, names=["width", "start", "n"]))


def log_checks(
    wv: pa.Array, wi: pa.Array, exponential: pa.Array, background: pa.Array, amplitude: pa.Array, te: pa.Array, noise: pa.Array,
    least: int, floor: float,
) -> pa.Array:
    """struct(ok, v0, v1) of every window: the block means of ln(signal / exponential), and the ends of the resolved signal."""
    (sv, _, v), (si, _, i), (se, size, e), (sb, _, b) = lists(wv), lists(wi), lists(exponential), lists(background)
    a, t, sigma = (column.to_numpy(zero_copy_only=False).astype(float) for column in (amplitude, te, noise))
    size = np.where(np.isnan(sigma), 0, size)
    row, place = places(se, size)
    e, c, v = e[place], i[places(si, size)[1]] - b[places(sb, size)[1]], v[places(sv, size)[1]]
    on = e >= np.fmax(SIGNAL_TO_NOISE * sigma, floor * a)[row]
    row, e, c, v = row[on], e[on], c[on], v[on]
    n = np.bincount(row, minlength=len(size))
    enough = (n >= least) & (np.bincount(row[~(c > 0)], minlength=len(size)) == 0)
    ok, ends = np.zeros(len(size), bool), np.full((2, len(size)), np.nan)
    rows = np.flatnonzero(enough)
    if len(rows):
        e, c, v, n = e[enough[row]], c[enough[row]], v[enough[row]], n[rows]
        stop, parts = np.cumsum(n), np.minimum(CHECK_BLOCKS, n // 3)
        ends[:, rows] = v[stop - n], v[stop - 1]
        of, block = places(np.zeros(len(rows), np.int64), parts)
        begin = (stop - n)[of] + block * (n // parts)[of] + np.minimum(block, (n % parts)[of])
        count = np.diff(np.append(begin, len(e)))
        mean = np.abs(np.add.reduceat(np.log(c / e), begin) / count)
        close = mean <= TE_MAX_BLOCK_DEVIATION_LOG + 3 * sigma[rows][of] * np.sqrt(np.add.reduceat(1.0 / (e * e), begin)) / count
        ok[rows] = np.logical_and.reduceat(close, np.cumsum(parts) - parts) & ((ends[1] - ends[0])[rows] / t[rows] >= 1)
    columns = [pa.array(ok), *(pa.array(end, mask=~enough) for end in ends)]
    return pa.StructArray.from_arrays(columns, names=["ok", "v0", "v1"])
