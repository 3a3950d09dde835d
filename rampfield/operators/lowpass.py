"""Zero-phase low-pass of long series by a recursive filter.

A recursive filter is an affine map of its state: over L samples the state z becomes
M^L z + e, where M belongs to the filter and e is what the samples leave behind when the
filter starts at rest. Series are cut into chunks, a row each. All chunks of a batch are
filtered from rest at once, as the columns of one array; the maps are then composed to the
state before every chunk by a prefix over groups of chunks and one over the groups, and that
state adds its decaying response to the chunk's output. A series never meets in one task:
what does is a row for each ``chunk * GROUP`` of its samples.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import butterworth_sections
from ..sources.scratch import written
from .keys import attach_by_key

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1024
GROUP = 1024
#: samples that are filtered together
AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Cascade:
    """Second-order sections in a row; the state is two numbers for each."""

    sections: tuple[tuple[float, ...], ...]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and last states of the columns of ``x``, each from rest."""
        return self._run(x, np.zeros((2 * len(self.sections), x.shape[1])))

    def _run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, z = np.array(x, float), np.array(state, float)
        for now in out:
            for s, (b0, b1, b2, a1, a2) in enumerate(self.sections):
                value = b0 * now + z[2 * s]
                z[2 * s] = b1 * now - a1 * value + z[2 * s + 1]
                z[2 * s + 1] = b2 * now - a2 * value
                now[:] = value
        return out, z

    @cached_property
    def step(self) -> np.ndarray:
        """M: what one sample of zero makes of every unit state."""
        size = 2 * len(self.sections)
        return self._run(np.zeros((1, size)), np.eye(size))[1]

    def response(self, length: int) -> np.ndarray:
        """(length, state): output of every unit state without input."""
        size = 2 * len(self.sections)
        return self._run(np.zeros((length, size)), np.eye(size))[0]

    @cached_property
    def settled(self) -> np.ndarray:
        """State after a long constant input of one."""
        out, gain = [], 1.0
        for b0, b1, b2, a1, a2 in self.sections:
            level = gain * (b0 + b1 + b2) / (1 + a1 + a2)
            out += [level - b0 * gain, b2 * gain - a2 * level]
            gain = level
        return np.array(out)


class _Powers:
    """M to the number of samples."""

    def __init__(self, cascade: Cascade) -> None:
        self.step, self.known = cascade.step, {}

    def after(self, length: int, state: np.ndarray) -> np.ndarray:
        """States (rows) after so many samples of zero."""
        if length not in self.known:
            self.known[length] = np.linalg.matrix_power(self.step, int(length))
        return state @ self.known[length].T

    def each(self, lengths: np.ndarray, states: np.ndarray) -> np.ndarray:
        out = np.empty_like(states)
        for n in np.unique(lengths):
            own = lengths == n
            out[own] = self.after(int(n), states[own])
        return out


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(all values, length of each list) of an Arrow list column; nulls become NaN."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = column.flatten().cast(pa.float64())
    return np.asarray(values.fill_null(float("nan"))), np.asarray(pc.list_value_length(column), dtype=np.int64)


def _arrow(values: np.ndarray, lengths: np.ndarray):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def at_rest(cascade: Cascade, values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(outputs one after the other, last states as rows) of many series, each from rest.

    Those of similar length are filtered together, in blocks of about ``AT_ONCE`` samples.
    """
    starts = np.cumsum(lengths) - lengths
    out = np.empty(len(values))
    ends = np.zeros((len(lengths), len(cascade.settled)))
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        n = int(lengths[order[at]])
        same = order[at : at + int(np.searchsorted(lengths[order[at:]], n, side="right"))]
        at += len(same)
        width = max(1, AT_ONCE // max(1, n))
        for k in range(0, len(same), width):
            own = same[k : k + width]
            where = starts[own] + np.arange(n)[:, None]
            y, z = cascade.run(values[where])
            out[where] = y
            ends[own] = z.T
    return out, ends


def _batches(names: list[str], change: Callable) -> Callable:
    """A mapInArrow function: the named columns stay, ``change`` makes the others from a batch."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                made = change(b)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(n)) for n in names] + list(made.values()), [*names, *made]
                )

    return work


def _prefix(maps: DataFrame, names: list[str], cascade: Cascade, kinds: str, totals: bool) -> DataFrame:
    """The state before every map of its group, and the samples before it in the group.

    ``maps`` has (names, _g, _h, _len, _end, _first), the groups (by two hashes) one after the
    other and each in the order of the pass. A group with a ``_first`` in its first row begins with the settled state of
    that sample and is ``_known``; others begin at rest, and what came before is still to be
    added. With ``totals`` a row for each whole group (``_whole``) follows: its length, and its
    state at the end as ``_state``.
    """
    size = len(cascade.settled)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers = _Powers(cascade)
        last, state, before, known, row = None, np.zeros(size), 0, False, None

        def emit(rows, states, befores, knowns, whole):
            n = len(befores)
            return pa.RecordBatch.from_arrays(
                [*rows, _arrow(states.ravel(), np.full(n, size)), pa.array(befores), pa.array(knowns), pa.array(np.full(n, whole))],
                [*names, "_state", "_before", "_known", "_whole"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            column = {n: b.column(j) for j, n in enumerate(b.schema.names)}
            own = [column[n] for n in names]
            groups = np.stack([np.asarray(column["_g"]), np.asarray(column["_h"])], axis=1)
            lengths = np.asarray(column["_len"])
            ends = _lists(column["_end"])[0].reshape(-1, size)
            first = np.asarray(column["_first"].cast(pa.float64()).fill_null(float("nan")))
            given = np.asarray(column["_first"].is_valid())
            new = np.concatenate([[last is None or (groups[0] != last).any()], (groups[1:] != groups[:-1]).any(axis=1)])
            heads = np.flatnonzero(np.concatenate([[True], new[1:]]))
            sizes = np.diff(np.append(heads, len(groups)))
            states = np.where(given[heads][:, None], np.nan_to_num(first[heads])[:, None] * cascade.settled, 0.0)
            states[given[heads] & np.isnan(first[heads])] = np.nan
            counts, knows = np.zeros(len(heads), np.int64), given[heads].copy()
            if not new[0]:
                states[0], counts[0], knows[0] = state, before, known
            elif row is not None and totals:
                yield emit(row, state[None], np.array([before]), np.array([known]), True)
            out, befores = np.empty((len(groups), size)), np.empty(len(groups), np.int64)
            for p in range(int(sizes.max())):
                live = np.flatnonzero(sizes > p)
                at = heads[live] + p
                out[at], befores[at] = states[live], counts[live]
                states[live] = powers.each(lengths[at], states[live]) + ends[at]
                counts[live] += lengths[at]
            yield emit(own, out, befores, np.repeat(knows, sizes), False)
            if totals and len(heads) > 1:
                closed = pa.array(heads[:-1])
                yield emit([c.take(closed) for c in own], states[:-1], counts[:-1], knows[:-1], True)
            last, state, before, known = groups[-1], states[-1], int(counts[-1]), bool(knows[-1])
            row = [c.slice(heads[-1], 1) for c in own]
        if totals and row is not None:
            yield emit(row, state[None], np.array([before]), np.array([known]), True)

    return maps.mapInArrow(scan, f"{kinds}, _state array<double>, _before bigint, _known boolean, _whole boolean")


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def states_before(maps: DataFrame, keys: list[str], cascade: Cascade, backward: bool) -> DataFrame:
    """(keys, _chunk, _state): the filter's state before every chunk, in the direction of the pass.

    ``maps`` has (keys, _chunk, _len, _end, _first), ``_first`` in the chunk where the pass begins.
    """
    sign = -1 if backward else 1
    maps = maps.withColumns({"_super": F.floor(F.col("_chunk") / GROUP), "_at": sign * F.col("_chunk")})
    small, rest = [*keys, "_super", "_chunk"], ["_g", "_h", "_len", "_end", "_first"]

    def in_order(df: DataFrame, group: list[str]) -> DataFrame:
        named = df.withColumns({"_g": F.xxhash64(*group), "_h": F.xxhash64(F.lit(1), *group)})
        return named.repartition("_g").sortWithinPartitions("_g", "_h", "_at")

    sorted_maps = in_order(maps, [*keys, "_super"]).select(*small, *rest)
    inner = written(_prefix(sorted_maps, small, cascade, _kinds(maps, small), True))
    # a row for each group, in the order of the pass
    upper = inner.where("_whole").select(
        *keys, "_super", F.col("_before").alias("_len"), F.col("_state").alias("_end"),
        F.when(F.col("_known"), F.lit(0.0)).alias("_first"), (sign * F.col("_super")).alias("_at"),
    )
    names = [*keys, "_super"]
    outer = _prefix(in_order(upper, keys).select(*names, *rest), names, cascade, _kinds(inner, names), False)
    starts = outer.select(*names, F.col("_state").alias("_start"))
    joined = attach_by_key(inner.where("not _whole"), starts, names)

    def settle(b) -> dict:
        column = {n: b.column(j) for j, n in enumerate(b.schema.names)}
        size = len(cascade.settled)
        state = _lists(column["_state"])[0].reshape(-1, size).copy()
        start = _lists(column["_start"])[0].reshape(-1, size)
        open_ = ~np.asarray(column["_known"])
        powers = _Powers(cascade)
        state[open_] += powers.each(np.asarray(column["_before"])[open_], start[open_])
        return {"_state": _arrow(state.ravel(), np.full(len(state), size))}

    kept = [*keys, "_chunk"]
    return joined.mapInArrow(_batches(kept, settle), f"{_kinds(joined, kept)}, _state array<double>")


def _chunk_rows(series: DataFrame, keys: list[str], value: str, k: str, chunk: int, reach: int) -> DataFrame:
    """(keys, _chunk, _x, _front, _back): chunks with their samples and, at the ends, the extension.

    A sample also goes to the chunk behind it if it lies at the end of its own, and the first
    sample of a chunk to the chunk before it; so a chunk knows whether it is the last, and has
    what an extension of the series needs, without a look at the whole series.
    """
    i = F.col(k).cast("bigint")
    home, place = F.floor(i / chunk), F.pmod(i, F.lit(chunk))
    to = F.array_compact(F.array(
        home, F.when(place >= chunk - reach, home + 1), F.when((place == 0) & (home > 0), home - 1),
    ))
    dealt = series.select(*keys, i.alias("_i"), F.col(value).cast("double").alias("_v"), F.explode(to).alias("_chunk"))
    own = F.sort_array(F.collect_list(F.struct("_i", "_v")))
    rows = dealt.groupBy(*keys, "_chunk").agg(own.alias("_all"))
    first = F.col("_chunk") * chunk
    rows = rows.select(
        *keys, "_chunk", F.explode(F.array(F.struct(
            F.filter("_all", lambda s: s["_i"] < first).alias("before"),
            F.filter("_all", lambda s: (s["_i"] >= first) & (s["_i"] < first + chunk)).alias("own"),
            F.exists("_all", lambda s: s["_i"] >= first + chunk).alias("more"),
        ))).alias("_p"),
    ).where(F.size("_p.own") > 0)
    n = F.size("_p.own")
    long_enough = (F.col("_chunk") > 0) | F.col("_p.more") | (n >= 2)
    checked = rows.where(F.assert_true(long_enough, F.lit("a series needs at least 2 samples.")).isNull())
    x = F.col("_p.own")
    mirrored = lambda piece, end: F.transform(F.reverse(piece), lambda s: 2 * end - s["_v"])
    front = F.when(F.col("_chunk") == 0, mirrored(F.slice(x, F.lit(2), F.least(n - 1, F.lit(reach))), x[0]["_v"]))
    known = F.concat("_p.before", x)
    at_most = F.least(F.size(known) - 1, F.lit(reach))
    ending = F.slice(known, F.size(known) - at_most, at_most)
    back = F.when(~F.col("_p.more"), mirrored(ending, F.element_at(x, -1)["_v"]))
    nothing = F.array().cast("array<double>")
    return checked.select(
        *keys, "_chunk", x["_v"].alias("_x"), F.coalesce(front, nothing).alias("_front"), F.coalesce(back, nothing).alias("_back"),
        (~F.col("_p.more")).alias("_last"),
    )


def zero_phase(
    series: DataFrame, keys: Sequence[str], sections: Sequence[tuple[float, ...]], value: str, k: str, chunk: int, out: str
) -> DataFrame:
    """Both passes of a cascade over series extended by odd reflection: (keys, k, out)."""
    keys, cascade = list(keys), Cascade(tuple(tuple(s) for s in sections))
    reach = 3 * (2 * len(cascade.sections) + 1)
    if chunk <= reach:
        raise ValueError(f"a chunk must have more than {reach} samples.")
    rows = _chunk_rows(series, keys, value, k, chunk, reach)
    ends = [*keys, "_chunk", "_last"]
    kinds = f"{_kinds(rows, ends)}, _y array<double>, _len bigint, _pad int, _own int, _end array<double>, _first double"
    size = len(cascade.settled)

    def started(y, lengths, pads, own, begins, first) -> dict:
        import pyarrow as pa

        filtered, states = at_rest(cascade, y, lengths)
        return {
            "_y": _arrow(filtered, lengths), "_len": pa.array(lengths), "_pad": pa.array(pads.astype(np.int32)),
            "_own": pa.array(own.astype(np.int32)), "_end": _arrow(states.ravel(), np.full(len(lengths), size)), "_first": pa.array(first, mask=~begins),
        }

    def forward(b) -> dict:
        column = {n: b.column(j) for j, n in enumerate(b.schema.names)}
        parts = [_lists(column[n]) for n in ("_front", "_x", "_back")]
        lengths = sum(n for _, n in parts)
        start = np.cumsum(lengths) - lengths
        y = np.empty(int(lengths.sum()))
        shift = np.zeros(len(lengths), np.int64)
        for values, n in parts:
            y[np.repeat(start + shift - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
            shift = shift + n
        return started(y, lengths, parts[0][1], parts[1][1], np.asarray(column["_chunk"]) == 0, y[start])

    def completed(column) -> tuple[np.ndarray, np.ndarray]:
        """Outputs with the response of the state before each chunk, and their lengths."""
        y, lengths = _lists(column["_y"])
        y = y.copy()
        state = _lists(column["_state"])[0].reshape(-1, size)
        answer = cascade.response(int(lengths.max()))
        start = np.cumsum(lengths) - lengths
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            for at in range(0, len(own), max(1, AT_ONCE // int(n))):
                some = own[at : at + max(1, AT_ONCE // int(n))]
                y[start[some][:, None] + np.arange(n)] += state[some] @ answer[:n].T
        return y, lengths

    def turned(y, lengths) -> np.ndarray:
        start = np.cumsum(lengths) - lengths
        return y[np.repeat(2 * start + lengths - 1, lengths) - np.arange(len(y))]

    def backward(b) -> dict:
        column = {n: b.column(j) for j, n in enumerate(b.schema.names)}
        y, lengths = completed(column)
        y = turned(y, lengths)
        start = np.cumsum(lengths) - lengths
        return started(y, lengths, np.asarray(column["_pad"]), np.asarray(column["_own"]), np.asarray(column["_last"]), y[start])

    def finished(b) -> dict:
        column = {n: b.column(j) for j, n in enumerate(b.schema.names)}
        y, lengths = completed(column)
        return {"_pad": column["_pad"], "_own": column["_own"], "_y": _arrow(turned(y, lengths), lengths)}

    maps = [*keys, "_chunk", "_len", "_end", "_first"]
    one = written(rows.mapInArrow(_batches(ends, forward), kinds))
    once = attach_by_key(one, states_before(one.select(*maps), keys, cascade, False), [*keys, "_chunk"])
    two = written(once.mapInArrow(_batches(ends, backward), kinds))
    twice = attach_by_key(two, states_before(two.select(*maps), keys, cascade, True), [*keys, "_chunk"])
    at_chunk = [*keys, "_chunk"]
    done = twice.mapInArrow(_batches(at_chunk, finished), f"{_kinds(rows, at_chunk)}, _pad int, _own int, _y array<double>")
    inside = F.slice("_y", F.col("_pad") + 1, F.col("_own"))
    place = (F.col("_chunk") * chunk + F.col("_p")).cast(series.schema[k].dataType)
    return done.select(*at_chunk, F.posexplode(inside).alias("_p", "_v")).select(
        *keys, place.alias(k), F.when(~F.isnan("_v"), F.col("_v")).alias(out)
    )


def butterworth(
    series: DataFrame, keys: Sequence[str], cutoff: float, fs: float | None = None,
    dt: float | None = None, order: int = 4, value: str = "value", k: str = "k",
    chunk: int = CHUNK, out: str = "smooth",
) -> DataFrame:
    """Zero-phase Butterworth low-pass of series numbered from 0 by ``k``: (keys, k, out).

    Give the sampling rate or the interval. Both ends are extended by odd reflection before
    the passes. A series of one sample fails; a missing sample makes the whole series NULL. A
    NULL key is a key.
    """
    rate = 1.0 / dt if fs is None and dt is not None else fs
    if rate is None:
        raise ValueError("the sampling rate is unknown: give fs or dt.")
    if rate <= 0:
        raise ValueError("a sampling rate is positive.")
    if not 0 < cutoff < rate / 2:
        raise ValueError(f"the cutoff lies between 0 and half the sampling rate, {rate / 2:g}.")
    return zero_phase(series, keys, butterworth_sections(order, cutoff, rate), value, k, chunk, out)
