"""Array arithmetic on one row.

A trace is one row whose samples (or voltage bins) sit in arrays, so every
per-trace step is a projection and needs no shuffle.  Two rules keep these
projections linear in the array length:

* a scalar used inside a lambda is bound once with :func:`let`, because the
  optimizer may otherwise inline the expression that computes it into the
  lambda body, where it would run again for every element;
* index ranges come from :func:`index_range`, since ``sequence(0, -1)`` counts
  downwards instead of being empty.
"""

from __future__ import annotations

from collections.abc import Callable

from .text import Text, X

DOUBLES = "array<double>"
INTS = "array<int>"
MAD_TO_SIGMA = 1.4826


def let(value: Text, body: Callable[[Text], Text]) -> Text:
    """Evaluate ``value`` once and make it available to ``body``."""
    return X.get(X.transform(X.array(value), body), X.lit(0))


def let_struct(body: Callable[[Text], Text], **fields: Text) -> Text:
    """Bind several named values at once; ``body`` receives the struct."""
    return let(X.struct(*[value.alias(name) for name, value in fields.items()]), body)


def index_range(start: Text | int, stop: Text | int) -> Text:
    """Integers in [start, stop), empty when the range is."""
    lo = X.lit(start) if isinstance(start, int) else start
    hi = X.lit(stop) if isinstance(stop, int) else stop
    return X.when(hi > lo, X.sequence(lo.cast("int"), (hi - 1).cast("int"))).otherwise(
        X.array().cast(INTS)
    )


def at(array: Text, index: Text | int) -> Text:
    """Element at a 0-based index, NULL outside the array."""
    idx = X.lit(index) if isinstance(index, int) else index.cast("int")
    return X.get(array, idx)


def last(array: Text) -> Text:
    return X.try_element_at(array, X.lit(-1))


def cut(array: Text, start: Text | int, length: Text | int) -> Text:
    """``length`` elements from the 0-based ``start``; negative lengths are empty."""
    begin = (X.lit(start) if isinstance(start, int) else start.cast("int")) + 1
    count = X.lit(length) if isinstance(length, int) else length.cast("int")
    return X.slice(array, X.greatest(begin, X.lit(1)), X.greatest(count, X.lit(0)))


def total(array: Text) -> Text:
    return X.aggregate(array, X.lit(0.0), lambda acc, x: acc + x)


def mean(array: Text) -> Text:
    return X.try_divide(total(array), X.size(array))


def dot(left: Text, right: Text) -> Text:
    return total(X.zip_with(left, right, lambda a, b: a * b))


def half(n: Text) -> Text:
    return X.shiftright(n, 1)


def sorted_middle(ordered: Text) -> Text:
    """Median of an already sorted array; NULL when empty."""
    n = X.size(ordered)
    return (at(ordered, half(n - 1)) + at(ordered, half(n))) / 2


def median(array: Text) -> Text:
    return let(X.sort_array(array), sorted_middle)


def mad_sigma(array: Text) -> Text:
    """Median absolute deviation scaled to a Gaussian standard deviation."""
    return let_struct(
        lambda s: X.lit(MAD_TO_SIGMA) * median(X.transform(s.a, lambda x: X.abs(x - s.m))),
        a=array,
        m=median(array),
    )


def diffs(array: Text) -> Text:
    """Differences of neighbouring elements."""
    return let(
        array,
        lambda a: X.transform(
            index_range(1, X.size(a)), lambda k: at(a, k) - at(a, k - 1)
        ),
    )


def prefix_length(array: Text, keep: Callable[[Text], Text]) -> Text:
    """Number of elements satisfying ``keep``; for a monotone array, a prefix."""
    return X.size(X.filter(array, keep))


def line_fit(x: Text, y: Text) -> Text:
    """Ordinary least squares as struct(slope, intercept, mx, sxx, residual)."""

    def solve(s: Text) -> Text:
        dx = X.transform(s.x, lambda v: v - s.mx)
        return let_struct(
            lambda t: let_struct(
                lambda u: X.struct(
                    u.slope.alias("slope"),
                    (u.my - u.slope * u.mx).alias("intercept"),
                    u.mx.alias("mx"),
                    u.my.alias("my"),
                    u.sxx.alias("sxx"),
                    X.zip_with(
                        u.x, u.y, lambda a, b: (b - u.my) - u.slope * (a - u.mx)
                    ).alias("residual"),
                ),
                x=t.x, y=t.y, mx=t.mx, my=t.my, sxx=t.sxx,
                slope=X.try_divide(t.sxy, t.sxx),
            ),
            x=s.x, y=s.y, mx=s.mx, my=s.my,
            sxx=total(X.transform(dx, lambda d: d * d)),
            sxy=total(X.zip_with(s.x, s.y, lambda a, b: (a - s.mx) * (b - s.my))),
        )

    return let_struct(solve, x=x, y=y, mx=mean(x), my=mean(y))


def split_start(b: Text, n: Text, parts: Text) -> Text:
    """First index of block ``b`` when ``n`` items are dealt into ``parts`` blocks.

    The first ``n mod parts`` blocks hold one extra item.
    """
    return b * X.floor(n / parts).cast("int") + X.least(b, n % parts)


def interpolate_at(point: Text, xs: Text, ys: Text) -> Text:
    """Linear interpolation at one point of an increasing grid, clamped at the ends."""

    def blend(s: Text) -> Text:
        k = X.greatest(X.lit(0), X.least(s.below - 1, X.size(s.x) - 2))
        return let_struct(
            lambda t: X.when(t.p <= t.x0, t.y0)
            .when(t.p >= t.x1, t.y1)
            .otherwise(t.y0 + (t.p - t.x0) * (t.y1 - t.y0) / (t.x1 - t.x0)),
            p=s.p, x0=at(s.x, k), x1=at(s.x, k + 1), y0=at(s.y, k), y1=at(s.y, k + 1),
        )

    return let_struct(
        lambda s: let_struct(
            blend, p=s.p, x=s.x, y=s.y, below=prefix_length(s.x, lambda v: v <= s.p)
        ),
        p=point, x=xs, y=ys,
    )


def spaced_grid(start: Text, stop: Text, n: Text) -> Text:
    """``n`` evenly spaced points with both ends exact."""
    return let_struct(
        lambda s: X.transform(
            index_range(0, s.n),
            lambda j: X.when(j == s.n - 1, s.b).otherwise(s.a + j * s.step),
        ),
        a=start, b=stop, n=n, step=(stop - start) / (n - 1),
    )


def interpolate_on_grid(n: Text, xs: Text, ys: Text) -> Text:
    """Values of a piecewise line at ``n`` even points over its own span.

    Each segment emits the grid points it covers, so the cost is linear in the
    number of nodes plus grid points and no search is needed.
    """

    def emit(s: Text) -> Text:
        def first_point(k: Text) -> Text:
            return X.ceil((at(s.x, k) - s.x0) / s.step).cast("int")

        def segment(k: Text) -> Text:
            return let_struct(
                lambda t: X.transform(
                    index_range(t.lo, X.least(t.hi, s.n - 1)),
                    lambda j: t.y0 + (s.x0 + j * s.step - t.xa) * t.slope,
                ),
                lo=X.when(k == 0, X.lit(0)).otherwise(first_point(k)),
                hi=X.when(k == X.size(s.x) - 2, s.n - 1).otherwise(first_point(k + 1)),
                xa=at(s.x, k),
                y0=at(s.y, k),
                slope=(at(s.y, k + 1) - at(s.y, k)) / (at(s.x, k + 1) - at(s.x, k)),
            )

        inner = X.flatten(X.transform(index_range(0, X.size(s.x) - 1), segment))
        return X.concat(inner, X.array(last(s.y)))

    return let_struct(
        lambda s: let_struct(
            emit, x=s.x, y=s.y, n=s.n, x0=at(s.x, 0),
            step=(last(s.x) - at(s.x, 0)) / (s.n - 1),
        ),
        x=xs, y=ys, n=n,
    )
