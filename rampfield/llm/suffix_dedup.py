"""Removal of long repeated byte strings, decided on a Burrows-Wheeler transform.

A string of ``size`` bytes that occurs twice holds, in both places, the same anchor: the
smallest hash among its ``gram``-byte windows. So the work is split by anchors:

1. Every document gives its anchors with a hash of the context, the bytes of all
   ``size``-byte strings around the anchor. Anchors that occur once are dropped; a context
   that occurs twice is covered as a whole and goes on as one representative.
2. Different contexts of one anchor form a group. Contexts that share no long enough core
   with another of their group are dropped; large groups are split by the hash of such
   cores until they are small, down to single strings, which need no further look.
3. The contexts of many groups are one text, with every shared core as one symbol. Its
   suffixes are sorted to a Burrows-Wheeler transform and all intervals are extended
   backwards, breadth first: round l finds the places where neighbouring suffixes share
   exactly l symbols. The expansion stops at the length that a string of ``size`` bytes has;
   the places that are left share that much or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import packed, stored, text_key
from .words import BLOCK, U, mix, utf8

SIZE, GRAM = 200, 100
#: contexts of one group that meet in a task; bytes of fragments held at once; bytes of one transform (an index takes 20 bits)
GROUP, HELD, TEXT = 40_000, 8_000_000, 1_000_000
#: hashes of byte windows: codes of bytes times powers of an odd base, summed up
_BASE, _INVERSE = 0x9E3779B97F4A7C17, pow(0x9E3779B97F4A7C17, -1, 1 << 64)
_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).view(U) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}
FRAGMENT = (
    "g bigint, lo int, hi int, k1 bigint, k2 bigint, pos bigint, copies bigint, off int, frag binary"
)


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK + 1), base, U)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=U)
    return have[:n]


def _slide(a: np.ndarray, f, width: int) -> np.ndarray:
    """f over every run of ``width`` elements, by doubling."""
    w = 1
    while 2 * w <= width:
        a = f(a[:-w], a[w:])
        w *= 2
    rest = width - w
    return f(a[:-rest], a[rest:]) if rest else a


def anchors(texts: list[bytes], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, position, anchor hash, context hash) of all anchors of texts of ``size`` bytes or more."""
    out, block, held = [], [], 0
    for k, t in enumerate(texts):
        if len(t) < size:
            continue
        for a in range(0, len(t), BLOCK):
            base = max(0, a - size)
            piece = t if len(t) <= BLOCK else t[base : a + BLOCK + 2 * size]
            block.append((k, base, a, piece))
            held += len(piece)
            if held >= BLOCK:
                out.append(_anchor_block(block, size, gram))
                block, held = [], 0
    if block:
        out.append(_anchor_block(block, size, gram))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    return tuple(np.concatenate(c) for c in zip(*out))


def _anchor_block(block: list, size: int, gram: int) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(b"".join(p for *_, p in block), np.uint8)
    lens = np.array([len(p) for *_, p in block])
    end = np.cumsum(lens)
    start = end - lens
    total = np.zeros(len(x) + 1, U)
    np.cumsum(_CODES[x] * powers(_BASE, len(x)), dtype=U, out=total[1:])
    inverse, width, none = powers(_INVERSE, len(x) + 1), size - gram + 1, U(2**64 - 1)
    h = mix((total[gram:] - total[:-gram]) * inverse[: len(x) - gram + 1])
    for e in end.tolist():
        h[e - gram + 1 : e] = none
    low = _slide(h, np.minimum, width)
    pad = np.zeros(width - 1, U)
    at = np.flatnonzero((_slide(np.concatenate([pad, low, pad]), np.maximum, width) == h) & (h != none))
    p = np.searchsorted(end, at, side="right")
    doc, base, a = (np.array([b[k] for b in block], np.int64) for k in range(3))
    pos = at - start[p] + base[p]
    keep = (pos >= a[p]) & (pos < a[p] + BLOCK)
    at, p, pos = at[keep], p[keep], pos[keep]
    left, right = np.maximum(at - (size - gram), start[p]), np.minimum(at + size, end[p])
    keep = right - left >= size
    at, p, pos, left, right = at[keep], p[keep], pos[keep], left[keep], right[keep]
    shape = (right - left).astype(U) * U(1000003) + (at - left).astype(U)
    return doc[p], pos, h[at], mix((total[right] - total[left]) * inverse[left] + mix(shape))


def anchor_table(rows: DataFrame, size: int, gram: int) -> DataFrame:
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            doc, pos, h, ctx = anchors(utf8(b.column(2)), size, gram)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), b.column(0).take(take),
                 b.column(1).take(take), pa.array(pos)],
                ["h", "ctx", "k1", "k2", "pos"],
            )

    return rows.select("k1", "k2", "text").mapInArrow(read, "h bigint, ctx bigint, k1 bigint, k2 bigint, pos bigint")


def cut(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """Fragments of (k1, k2, text, marks): the context of every marked anchor."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols = [[] for _ in range(9)]
            for k1, k2, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist()):
                for m in marks:
                    left = max(0, m["pos"] - (size - gram))
                    row = (m["h"], 0, size - gram + 1, k1, k2, m["pos"], m["copies"], m["pos"] - left, t[left : m["pos"] + size])
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in FRAGMENT.split(", ")]
            )

    return texts.select("k1", "k2", "text", "marks").mapInArrow(read, FRAGMENT)


def _grid(frags: list[bytes], off: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments as rows with the anchor in one column; the first column used and the last but one."""
    width = 2 * size - gram
    first = size - gram - off
    last = first + np.array([len(f) for f in frags], np.int64)
    rows = b"".join([bytes(a) + f + bytes(width - e) for f, a, e in zip(frags, first.tolist(), last.tolist())])
    return np.frombuffer(rows, np.uint8).reshape(len(frags), width), first, last


def hashed(grid: np.ndarray, a: int, b: int) -> np.ndarray:
    """A hash of columns a to b of every row."""
    part = grid[:, a:b]
    h = np.zeros(len(grid), U)
    for k in range(0, part.shape[1], 8):
        some = part[:, k : k + 8]
        if some.shape[1] < 8:
            some = np.pad(some, ((0, 0), (0, 8 - some.shape[1])))
        h = mix(h * U(_BASE) + np.ascontiguousarray(some).view(U).ravel())
    return h


def cores(grid: np.ndarray, first: np.ndarray, last: np.ndarray, a: int, b: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the bytes that all strings starting in columns a..b-1 share; whether a row has them."""
    return hashed(grid, b - 1, a + size), (first <= b - 1) & (last >= a + size)


def _parts(lo: int, hi: int, n: int = 4) -> list[tuple[int, int]]:
    edges = sorted({lo + (hi - lo) * k // n for k in range(n + 1)})
    return list(zip(edges, edges[1:]))


def split_groups(frags: DataFrame, size: int, gram: int) -> DataFrame:
    """Fragments once for each part of their range of strings, grouped by that part's core."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in FRAGMENT.split(", ")]
        for b in batches:
            if not b.num_rows:
                continue
            g, lo, hi = (b.column(k).to_numpy() for k in range(3))
            grid, first, last = _grid(b.column(8).to_pylist(), b.column(7).to_numpy(), size, gram)
            for rlo, rhi in sorted(set(zip(lo.tolist(), hi.tolist()))):
                mine = (lo == rlo) & (hi == rhi)
                for a, e in _parts(rlo, rhi):
                    h, ok = cores(grid, first, last, a, e, size)
                    some = np.flatnonzero(mine & ok)
                    new = mix(h[some] ^ mix(g[some].view(U) + U(a * 1009 + e)))
                    take = b.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(new.view(np.int64)), pa.array(np.full(len(some), a, np.int32)),
                         pa.array(np.full(len(some), e, np.int32)), *[take.column(k) for k in range(3, 9)]],
                        names,
                    )

    return frags.mapInArrow(read, FRAGMENT)


def burrows_wheeler(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, transform) of the rotations of x, sorted by their first ``size`` symbols or more."""
    index, mask = np.arange(len(x), dtype=U), U(0xFFFFF)
    rank, done = np.unique(x, return_inverse=True)[1].astype(U), 1
    keys = np.sort(rank << U(20) | index)
    while True:
        order, head = (keys & mask).astype(np.int64), keys >> U(20)
        new = np.concatenate([[False], head[1:] != head[:-1]])
        rank[order] = np.cumsum(new, dtype=U)
        if done >= size or new.sum() == len(x) - 1:
            return order, x[order - 1]
        keys = np.sort(rank << U(40) | np.roll(rank, -done) << U(20) | index)
        done *= 2


def shared_prefixes(bwt: np.ndarray, size: int) -> np.ndarray:
    """For every place of the sorted order, whether it shares ``size`` symbols with the place before.

    Breadth-first backward extension: the border between two intervals of prefix length l
    moves, for every symbol c that stands in the transform within the interval behind the
    border, to the first suffix of that interval preceded by c. There the common prefix is
    l + 1, unless a shorter one was found in an earlier round.
    """
    n = len(bwt)
    by_char = np.argsort(bwt, kind="stable")
    target = np.empty(n, np.int64)
    target[by_char] = np.arange(n)
    before = np.full(n, -1)
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    before[by_char[1:][same]] = by_char[:-1][same]
    border = np.zeros(n + 1, bool)
    border[n] = True
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    border[heads] = True
    new = heads
    for _ in range(1, size):
        if not len(new):
            break
        old = np.flatnonzero(border) if 4 * len(new) > n else None
        if old is not None:
            stop = old[np.searchsorted(old, new, side="right")]
        else:
            stop = _next_border(border, new)
        lens = stop - new
        place = np.repeat(new - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        fresh = before[place] < np.repeat(new, lens)
        to = target[place[fresh]]
        to = np.unique(to[~border[to]])
        border[to] = True
        new = to
    return ~border[:n]


def _next_border(border: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next border after each place: short gaps are walked, the rest looked up."""
    stop = at + 1
    open_ = np.flatnonzero(~border[stop])
    for _ in range(16):
        if not len(open_):
            return stop
        stop[open_] += 1
        open_ = open_[~border[stop[open_]]]
    if len(open_):
        every = np.flatnonzero(border)
        stop[open_] = every[np.searchsorted(every, stop[open_], side="left")]
    return stop


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each class, class sizes for every element) of equal keys."""
    _, first, where, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, n[where]


def judge(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, frags: list[bytes], off: np.ndarray, size: int, gram: int):
    """(fragment, column) of all strings that another fragment of the group has at the same column.

    Strings are taken by parts of their columns. Fragments that are equal in all bytes of a
    part are covered there and go on as one; what shares the core of a part with others goes
    into a transform. A class of equal cores too large for one is taken in smaller parts.
    """
    grid, first, last = _grid(frags, off, size, gram)
    owners, columns, pool = [], [], []
    todo = []
    for rlo, rhi in sorted(set(zip(lo.tolist(), hi.tolist()))):
        mine = np.flatnonzero((lo == rlo) & (hi == rhi))
        todo += [(mine, g[mine].view(U), a, e) for a, e in _parts(rlo, rhi)]
    while todo:
        ids, key, a, e = todo.pop()
        h, ok = cores(grid[ids], first[ids], last[ids], a, e, size)
        ids, key, h = ids[ok], key[ok], h[ok]
        full = (first[ids] <= a) & (last[ids] >= e - 1 + size)
        whole = mix(hashed(grid[ids], a, e - 1 + size) ^ mix(key))
        one, n = _classes(whole[full])
        again = ids[full][n > 1]
        owners.append(np.repeat(again, e - a))
        columns.append(np.tile(np.arange(a, e), len(again)))
        if e - a == 1:
            continue
        rest = np.concatenate([np.flatnonzero(full)[one], np.flatnonzero(~full)])
        core = mix(h[rest] ^ mix(key[rest] + U(a * 1009 + e)))
        _, n = _classes(core)
        shared = n > 1
        large = 2 * n * (e - a) > TEXT
        some = rest[shared & large]
        todo += [(ids[some], core[shared & large], c, d) for c, d in _parts(a, e)] if len(some) else []
        some = shared & ~large
        pool.append((ids[rest[some]], core[some], np.full(some.sum(), a), np.full(some.sum(), e)))
    owner, core, a, e = (np.concatenate(c) for c in zip(*pool)) if pool else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((core, e - a))
    owner, core, a, e = owner[order], core[order], a[order], e[order]
    width = e - a
    start, stop = np.maximum(a, first[owner]), np.minimum(e - 1 + size, last[owner])
    # a core is one symbol of the transform
    upto = np.cumsum(stop - start - (size - width))
    ends = np.flatnonzero(np.append((core[1:] != core[:-1]) | (width[1:] != width[:-1]), True)) + 1 if len(core) else []
    at = 0
    for k, end in enumerate(ends):
        if (
            k + 1 == len(ends) or width[end] != width[at]
            or upto[ends[k + 1] - 1] - (upto[at - 1] if at else 0) > TEXT
        ):
            cut_ = slice(at, end)
            o, c = _expand(grid, owner[cut_], core[cut_], a[cut_], e[cut_], start[cut_], stop[cut_], size)
            owners.append(o)
            columns.append(c)
            at = end
    return (np.concatenate(owners), np.concatenate(columns)) if owners else (np.zeros(0, np.int64),) * 2


def _expand(grid, owner, core, a, e, start, stop, size) -> tuple[np.ndarray, np.ndarray]:
    """Strings of the given columns of fragments that another one of equal core has at the same column."""
    width = int(e[0] - a[0])
    # the bytes before the core, the core as a symbol of its class, the bytes after it
    skip = size - width
    lens = stop - start - skip
    row = np.repeat(np.arange(len(owner)), lens)
    column = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + start[row]
    middle = e[row] - 1
    x = grid[owner[row], np.where(column > middle, column + skip, column)].astype(np.int64)
    at_core = column == middle
    x[at_core] = 256 + np.unique(core, return_inverse=True)[1][row[at_core]]
    # a string of ``size`` bytes that starts in the part has the core and ``width - 1`` other bytes
    order, bwt = burrows_wheeler(x, width)
    kind = np.empty(len(x), np.int64)
    kind[order] = np.cumsum(~shared_prefixes(bwt, width))
    valid = (column >= a[row]) & (column < e[row]) & (column + size <= stop[row])
    row, column, kind = row[valid], column[valid], kind[valid]
    # the same string at the same column of the same class: elsewhere, as contexts differ in place
    order = np.lexsort((column, kind, core[row]))
    x, y, z = core[row][order], kind[order], column[order]
    twin = (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (z[1:] == z[:-1])
    hit = np.zeros(len(order), bool)
    hit[1:] |= twin
    hit[:-1] |= twin
    return owner[row[order[hit]]], column[order[hit]]


def judged(frags: DataFrame, size: int, gram: int) -> DataFrame:
    """(k1, k2, span) of fragments sorted by group: spans of repeated strings, as start * 1024 + length."""

    def flush(parts: list):
        import pyarrow as pa

        b = pa.Table.from_batches(parts).combine_chunks()
        g, lo, hi, k1, k2, pos, copies, off = (b.column(k).to_numpy() for k in range(8))
        owner, column = judge(g, lo, hi, b.column(8).to_pylist(), off, size, gram)
        single = copies[owner] == 1
        cell = np.unique(owner[single] * 4096 + column[single])
        owner, column = cell >> 12, cell & 4095
        start = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(column) != 1)])) if len(owner) else np.zeros(0, np.int64)
        stop = np.append(start[1:], len(owner)) - 1 if len(owner) else start
        k = owner[start]
        begin = pos[k] + column[start] - (size - gram)
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[k]), pa.array(k2[k]), pa.array(begin * 1024 + column[stop] - column[start] + size)],
            ["k1", "k2", "span"],
        )

    def read(batches: Iterator) -> Iterator:
        parts, held, last = [], 0, None
        for b in batches:
            g, sizes = b.column(0).to_numpy(), np.array([len(f) for f in b.column(8).to_pylist()])
            heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            ends = np.append(heads[1:], len(g)) if len(g) else []
            at = 0
            for s, e in zip(heads, ends):
                weight = int(sizes[s:e].sum())
                if held and held + weight > HELD and g[s] != last:
                    if s > at:
                        parts.append(b.slice(at, s - at))
                    yield flush(parts)
                    parts, held, at = [], 0, s
                held += weight
                last = g[s]
            if len(g) > at:
                parts.append(b.slice(at))
        if parts:
            yield flush(parts)

    return frags.mapInArrow(read, "k1 bigint, k2 bigint, span bigint")


def repeated_spans(rows: DataFrame, size: int, gram: int, group: int) -> DataFrame:
    """(k1, k2, span) of all repeated strings of the texts (k1, k2, text)."""
    table = stored(anchor_table(rows, size, gram))
    repeated = table.groupBy("h").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).filter("n > 1")
    # tables of their own, so that joins read plain exchanges and can split frequent anchors
    repeated = stored(repeated.select("h", (F.col("lo") != F.col("hi")).alias("mixed")))
    found = stored(table.join(repeated, "h"))
    contexts = found.groupBy("h", "ctx").agg(
        F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "pos")).alias("at"), F.first("mixed").alias("mixed")
    )
    contexts = stored(contexts)
    whole = (
        found.join(contexts.filter("copies > 1").select("h", "ctx"), ["h", "ctx"])
        .select("k1", "k2", F.col("pos").alias("span"), F.lit(True).alias("whole")).distinct()
    )
    marks = contexts.filter("mixed").select("at.*", "h", "copies").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("h", "pos", "copies")).alias("marks")
    )
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(marks, ["k1", "k2"])
    frags = stored(cut(texts, size, gram))
    spans = []
    while True:
        counts = frags.groupBy("g").agg(F.count("*").alias("members")).filter("members > 1")
        sized = frags.join(counts, "g")
        few = sized.filter(F.col("members") <= group).drop("members")
        spans.append(stored(judged(few.repartition("g").sortWithinPartitions("g"), size, gram)))
        many = stored(sized.filter(F.col("members") > group).drop("members"))
        exact = F.col("hi") - F.col("lo") == 1
        spans.append(
            many.filter(exact & (F.col("copies") == 1))
            .select("k1", "k2", ((F.col("pos") + F.col("lo") - (size - gram)) * 1024 + size).alias("span"))
        )
        many = many.filter(~exact)
        if many.limit(1).count() == 0:
            break
        frags = stored(split_groups(many, size, gram))
    out = whole
    for s in spans:
        out = out.unionByName(s.withColumn("whole", F.lit(False)))
    return out


def remove(text: bytes, whole: list[int], spans: list[int], size: int, gram: int) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, runs removed) of a text without its repeated strings.

    ``whole`` are anchors whose context is covered, ``spans`` hold start * 1024 + length.
    """
    if not whole and not spans:
        return text, 0, 0
    w, s = np.array(whole, np.int64), np.array(spans, np.int64)
    start = np.concatenate([np.maximum(0, w - (size - gram)), s >> 10])
    stop = np.concatenate([np.minimum(len(text), w + size), (s >> 10) + (s & 1023)])
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, group: int = GROUP,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary): texts without their repeated strings.

    Every byte goes that lies in a string of ``size`` bytes that starts anywhere else too, in
    the same text or another. Null texts have no bytes; texts shorter than ``size`` stay.
    Repeated rows are copies of each other. Kept bytes need not be valid UTF-8.
    """
    if not 0 < gram <= size or 2 * size - gram >= 1024:
        raise ValueError("gram must be at most size, and a context shorter than 1024 bytes")
    rows = packed(docs, id_col, text_col).select("id", F.col("text").cast("string").alias("text")).withColumns(text_key())
    spans = stored(repeated_spans(rows, size, gram, group))
    per_text = spans.groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("whole"), F.col("span"))).alias("whole"),
        F.collect_set(F.when(~F.col("whole"), F.col("span"))).alias("spans"),
    )

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows_ = [
                (len(t), *remove(t, w or [], s or [], size, gram))
                for t, w, s in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            n, kept, gone, runs = zip(*rows_) if rows_ else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.join(per_text, ["k1", "k2"], "left").select("id", "text", "whole", "spans").mapInArrow(
        read, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
