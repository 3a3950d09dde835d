"""Local polynomial (Savitzky-Golay) and filter kernels.

Polynomial smoothing of ``w`` even samples is a projection on the discrete
orthogonal polynomials of the window.  With centred positions t these obey

    P0 = 1,  P1 = t,  P(k+1) = t Pk - b(k) P(k-1),
    b(k) = k^2 (w^2 - k^2) / (4 (4 k^2 - 1)),   sum Pk^2 = w b(1) ... b(k),

which holds for even and odd windows alike.  The window may therefore be a
column (it differs from trace to trace) while the order is known to the plan.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

from .arrays import at, cut, dot, index_range, let_struct
from .text import Text, X

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta(k: int, w: Text) -> Text:
    return X.lit(float(k * k)) * (w * w - float(k * k)) / float(4 * (4 * k * k - 1))


def _basis(t: Text, w: Text, order: int) -> tuple[list[Text], list[Text], list[Text]]:
    """Values, derivatives and squared norms of P0..P(order) at position ``t``."""
    value, slope, norm = [X.lit(1.0)], [X.lit(0.0)], [w]
    if order >= 1:
        value.append(t)
        slope.append(X.lit(1.0))
        norm.append(w * _beta(1, w))
    for k in range(1, order):
        value.append(t * value[k] - _beta(k, w) * value[k - 1])
        slope.append(value[k] + t * slope[k] - _beta(k, w) * slope[k - 1])
        norm.append(norm[k] * _beta(k + 1, w))
    return value, slope, norm


def basis_values(t: np.ndarray, w: int, order: int) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Values, derivatives and squared norms of P0..P(order) at positions of one window."""
    beta = lambda k: float(k * k) * (w * w - float(k * k)) / float(4 * (4 * k * k - 1))
    value, slope, norm = [np.ones(len(t)), t], [np.zeros(len(t)), np.ones(len(t))], [float(w), w * beta(1)]
    for k in range(1, order):
        value.append(t * value[k] - beta(k) * value[k - 1])
        slope.append(value[k] + t * slope[k] - beta(k) * slope[k - 1])
        norm.append(norm[k] * beta(k + 1))
    return value, slope, norm


def _terms(at_t: Text, w: Text, order: int, deriv: int) -> list[Text]:
    value, slope, norm = _basis(at_t, w, order)
    chosen = slope if deriv else value
    return [c / n for c, n in zip(chosen, norm)]


def local_polynomial(samples: Text, window: Text, order: int, deriv: int = 0) -> Text:
    """Fit a polynomial over a sliding window and evaluate it (or its slope).

    Interior samples use the window around them; the first and last
    ``window // 2`` samples use the polynomial of the edge window.  An even
    window covers ``window / 2 - 1`` samples before and ``window / 2`` after and
    is evaluated at its own centre.  The slope is per sample.
    """
    if deriv not in (0, 1):
        raise ValueError("deriv must be 0 or 1")

    def centred(j: Text, s: Text) -> Text:
        return j.cast("double") - (s.w - 1) / 2

    def weights(s: Text) -> Text:
        def weight(j: Text) -> Text:
            value, _, _ = _basis(centred(j, s), s.w, order)
            parts = [at(s.centre, k) * value[k] for k in range(order + 1)]
            out = parts[0]
            for part in parts[1:]:
                out = out + part
            return out

        return X.transform(index_range(0, s.w), weight)

    def project(s: Text, start: Text) -> Text:
        """Coefficients of the edge window that begins at ``start``."""
        piece = cut(s.y, start, s.w)

        def coefficient(k: int) -> Text:
            column = X.transform(
                index_range(0, s.w), lambda j: _basis(centred(j, s), s.w, order)[0][k]
            )
            return dot(piece, column)

        return X.array(*[coefficient(k) for k in range(order + 1)])

    def edge(s: Text, coefficients: Text, first: Text | int, count: Text) -> Text:
        def evaluate(j: Text) -> Text:
            terms = _terms(centred(j, s), s.w, order, deriv)
            out = at(coefficients, 0) * terms[0]
            for k in range(1, order + 1):
                out = out + at(coefficients, k) * terms[k]
            return out

        return X.transform(index_range(first, first + count if not isinstance(first, int) else X.lit(first) + count), evaluate)

    def assemble(s: Text) -> Text:
        n = X.size(s.y)
        before = s.w - 1 - s.h
        interior = X.transform(
            index_range(s.h, n - s.h),
            lambda j: dot(cut(s.y, j - before, s.w), s.kernel),
        )
        return X.concat(
            edge(s, s.left, 0, s.h), interior, edge(s, s.right, s.w - s.h, s.h)
        )

    def with_kernel(s: Text) -> Text:
        return let_struct(
            assemble, y=s.y, w=s.w, h=s.h, kernel=weights(s),
            left=project(s, X.lit(0)), right=project(s, X.size(s.y) - s.w),
        )

    def with_centre(s: Text) -> Text:
        return let_struct(
            with_kernel, y=s.y, w=s.w, h=X.shiftright(s.w, 1),
            centre=X.array(*_terms(X.lit(0.0), s.w.cast("double"), order, deriv)),
        )

    return let_struct(with_centre, y=samples, w=window.cast("int"))


def polynomial_weights(window: int, order: int, at_position: float) -> list[float]:
    """Weights that evaluate the window's least-squares polynomial at a position.

    Positions count from 0 at the first sample of the window.
    """
    t = np.arange(window) - (window - 1) / 2
    design = np.vander(t, order + 1, increasing=True)
    point = (at_position - (window - 1) / 2) ** np.arange(order + 1)
    return [float(x) for x in point @ np.linalg.pinv(design)]


def polynomial_solution(window: int, order: int) -> list[list[float]]:
    """Per power, the samples' weights in the window's least-squares polynomial about its middle."""
    t = np.arange(window) - (window - 1) / 2
    return np.linalg.pinv(np.vander(t, order + 1, increasing=True)).tolist()


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights at -r..r with r = round-half-up(truncate * sigma)."""
    radius = int(truncate * float(sigma) + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    scale = sum(raw)
    return [x / scale for x in raw]


def butterworth_sections(order: int, cutoff_hz: float, fs_hz: float) -> list[tuple[float, ...]]:
    """Second-order sections (b0, b1, b2, a1, a2) of a low-pass Butterworth filter.

    Bilinear transform of the analogue prototype with pre-warped cutoff; a first
    order section (b2 = a2 = 0) comes first when the order is odd.
    """
    if order < 1:
        raise ValueError("butter_order must be at least 1")
    warped = math.tan(math.pi * cutoff_hz / fs_hz)
    sections: list[tuple[float, ...]] = []
    if order % 2:
        d = 1.0 + warped
        sections.append((warped / d, warped / d, 0.0, (warped - 1.0) / d, 0.0))
    for m in range(order // 2):
        damping = 2.0 * math.sin(math.pi * (2 * m + 1) / (2 * order))
        d = 1.0 + damping * warped + warped**2
        gain = warped**2 / d
        sections.append(
            (gain, 2 * gain, gain, 2 * (warped**2 - 1) / d, (1 - damping * warped + warped**2) / d)
        )
    return sections
