"""Ranked search over bit-sliced Bloom signatures, with exact scores for what they cannot exclude.

Documents of similar size stand side by side in blocks. Each has a signature: a Bloom filter
over its terms, in which a term is entered once for every step of ``STEPS`` that its count
reaches. Signatures are stored by bit: a slice is the bitmap, over the documents of the block,
of one bit. The slices of a term and step, combined by AND, hold every document that reaches
the step, and perhaps more. What a step can add to a score, times its bitmap, summed over the
terms of a query, is therefore never less than the score. Documents with the highest sums are
scored exactly first; then all whose sum is not below the k-th of these scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import packed, stored
from .words import ALNUM, U, mix, utf8, word_hashes

#: counts of a term from which it is entered once more
STEPS = (1, 2, 3, 5, 9, 17, 33)
BITS, HASHES = 10, 4
#: documents of a block, and entries after which a task cuts what it holds into blocks
DOCS, ENTRIES = 256, 3_000_000
#: terms of queries that one round over the index looks up; more take more rounds
ROUND_TERMS = 200_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP_ODD = U(0xD6E8FEB86659FD93)


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


# --- scores: 64-bit integers throughout ----------------------------------------------


def length_norm(n, docs: int, total: int):
    """The part of a score's denominator that grows with a document's number of terms."""
    return 10 + (90 * n * docs) // total


def gain(tf, m):
    """What a term of weight 1 adds; grows with its count ``tf`` and falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# --- index ---------------------------------------------------------------------------


def places(h: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    """(entries, HASHES): the bits of terms entered for a step, by double hashing."""
    x = mix(h + step.astype(U) * _STEP_ODD)
    first, stride = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
    each = (first[:, None] + stride[:, None] * np.arange(HASHES, dtype=U)) & U(0xFFFFFFFF)
    return ((each * U(bits)) >> U(32)).astype(np.int64)


def counted(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the words of documents with ``n`` words each."""
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def sliced(doc: np.ndarray, term: np.ndarray, count: np.ndarray, docs: int) -> tuple[int, bytes]:
    """(bits of a signature, slices one after the other) of a block."""
    reached = np.searchsorted(np.array(STEPS), count, side="right")
    which = np.repeat(np.arange(len(doc)), reached)
    step = np.arange(len(which)) - np.repeat(np.cumsum(reached) - reached, reached)
    entries = np.bincount(doc, weights=reached, minlength=docs).max()
    bits = max(64, int(entries) * BITS)
    held = np.zeros((bits, docs), np.uint8)
    held[places(term[which], step, bits), doc[which][:, None]] = 1
    return bits, np.packbits(held, axis=1).tobytes()


class _Chunk:
    """Documents of a task that wait to be cut into blocks."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.docs = self.entries = 0

    def add(self, ids, keys: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((ids, keys, n, doc + self.docs, term, count))
        self.docs += len(n)
        self.entries += len(doc)

    def blocks(self) -> Iterator:
        import pyarrow as pa

        ids = pa.concat_arrays([p[0] for p in self.parts])
        keys, n, doc, term, count = (np.concatenate([p[k] for p in self.parts]) for k in range(1, 6))
        terms, df = np.unique(term, return_counts=True)
        # by size; documents without terms never score
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        rank = np.full(len(n), -1)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[doc], kind="stable")
        doc, term, count = rank[doc][by], term[by], count[by]
        for start in range(0, len(order), DOCS):
            own = order[start : start + DOCS]
            a, b = np.searchsorted(doc, [start, start + len(own)])
            bits, slices = sliced(doc[a:b] - start, term[a:b], count[a:b], len(own))
            vocabulary = (terms, df) if start == 0 else (terms[:0], df[:0])

            def listed(values) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            yield pa.RecordBatch.from_arrays(
                [
                    listed(ids.take(pa.array(own))), listed(pa.array(keys[own])), listed(pa.array(n[own])),
                    pa.array([bits], pa.int32()), pa.array([slices], pa.binary()),
                    listed(pa.array(vocabulary[0].view(np.int64))), listed(pa.array(vocabulary[1])),
                ],
                ["ids", "keys", "sizes", "bits", "slices", "terms", "dfs"],
            )


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row for each block with its ids, text hashes, sizes and slices.

    The first block of those that a task cuts at once also lists its terms with the number of
    documents that hold them. Null texts and texts without terms are in no block.
    """
    rows = packed(docs, id_col, text_col).select("id", F.col("text").cast("string").alias("text"))
    rows = rows.select("id", text_hash(F.col("text")).alias("key"), "text")
    kind = rows.schema["id"].dataType.simpleString()

    def build(batches: Iterator) -> Iterator:
        chunk = _Chunk()
        for b in batches:
            texts = utf8(b.column(2))
            at, size = 0, 0
            # texts that are long together are counted in pieces
            for k, t in enumerate(texts):
                size += len(t)
                if size > 4_000_000 or k == len(texts) - 1:
                    h, n = word_hashes(texts[at : k + 1], ALNUM)
                    chunk.add(b.column(0).slice(at, k + 1 - at), np.asarray(b.column(1))[at : k + 1], n, *counted(h, n))
                    at, size = k + 1, 0
                    if chunk.entries >= ENTRIES:
                        yield from chunk.blocks()
                        chunk = _Chunk()
        if chunk.docs:
            yield from chunk.blocks()

    return stored(rows.mapInArrow(
        build,
        f"ids array<{kind}>, keys array<bigint>, sizes array<bigint>, bits int, slices binary, terms array<bigint>, dfs array<bigint>",
    ))


# --- queries -------------------------------------------------------------------------


@dataclass(frozen=True)
class Asked:
    """Queries of a round: distinct ``terms`` with hash and weight; query j has terms ``of[at[j]:at[j + 1]]``."""

    terms: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    of: np.ndarray
    at: np.ndarray
    docs: int
    total: int


def bounds(row: dict, asked: Asked) -> np.ndarray:
    """(queries, documents): sums that no score in the block exceeds; exact in doubles."""
    sizes, bits = np.asarray(row["sizes"]), row["bits"]
    n = len(sizes)
    slices = np.frombuffer(row["slices"], np.uint8).reshape(bits, -1)
    # the block's smallest document has the largest gains
    m = int(length_norm(int(sizes.min()), asked.docs, asked.total))
    value = np.zeros((len(asked.terms), n))
    left, held = np.arange(len(asked.terms)), None
    for k, step in enumerate(STEPS):
        found = np.bitwise_and.reduce(slices[places(asked.hashes[left], np.full(len(left), k), bits)], axis=1)
        # who reaches a step has reached those before
        held = found if held is None else found & held
        some = held.any(axis=1)
        left, held = left[some], held[some]
        if not len(left):
            break
        most = STEPS[k + 1] - 1 if k + 1 < len(STEPS) else max(step, int(sizes.max()))
        more = gain(most, m) - (gain(step - 1, m) if step > 1 else 0)
        value[left] += np.unpackbits(held, axis=1, count=n) * (asked.weights[left] * more)[:, None]
    out = np.zeros((len(asked.at) - 1, n))
    full = np.flatnonzero(np.diff(asked.at))
    if len(full):
        out[full] = np.add.reduceat(value[asked.of], asked.at[full], axis=0)
    return out


def _rows(batches: Iterator) -> Iterator:
    for b in batches:
        for k in range(b.num_rows):
            values = {c: b.column(j)[k] for j, c in enumerate(b.schema.names)}
            yield values["ids"].values, np.asarray(values["keys"].values), {
                "sizes": np.asarray(values["sizes"].values), "bits": values["bits"].as_py(), "slices": values["slices"].as_py()
            }


def first_looks(blocks: DataFrame, asked, top: int) -> DataFrame:
    """(query, id, key): of each query the ``top`` documents with the highest sums, by task."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = ids = keys = None
        for own, own_keys, row in _rows(batches):
            sums = bounds(row, asked.value)
            if best is None:
                at = np.broadcast_to(np.arange(len(own)), sums.shape)
                best, ids, keys, own_keys = sums, [own], at, own_keys
                known = own_keys
            else:
                at = np.broadcast_to(np.arange(len(own)) + sum(map(len, ids)), sums.shape)
                best, keys = np.concatenate([best, sums], axis=1), np.concatenate([keys, at], axis=1)
                ids.append(own)
                known = np.concatenate([known, own_keys])
            if best.shape[1] > top:
                some = np.argpartition(-best, top - 1, axis=1)[:, :top]
                best, keys = np.take_along_axis(best, some, 1), np.take_along_axis(keys, some, 1)
            if len(ids) > 64:
                # only documents that are still held are kept
                used, keys = np.unique(keys, return_inverse=True)
                keys = keys.reshape(best.shape)
                ids, known = [pa.concat_arrays(ids).take(pa.array(used))], known[used]
        if best is None:
            return
        query, place = np.nonzero(best > 0)
        doc = keys[query, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.concat_arrays(ids).take(pa.array(doc)), pa.array(known[doc]), pa.array(best[query, place])],
            ["query", "id", "key", "most"],
        )

    found = blocks.select("ids", "keys", "sizes", "bits", "slices").mapInArrow(look, f"query int, id {kind}, key bigint, most double")
    order = Window.partitionBy("query").orderBy(F.desc("most"), "id", "key")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).select("query", "id", "key")


def not_excluded(blocks: DataFrame, asked, least: np.ndarray) -> DataFrame:
    """(id, key, queries): every document whose sum for a query is not below ``least`` of it."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for own, own_keys, row in _rows(batches):
            sums = bounds(row, asked.value)
            doc, query = np.nonzero(((sums >= least[:, None]) & (sums > 0)).T)
            some, n = np.unique(doc, return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [own.take(pa.array(some)), pa.array(own_keys[some]), pa.ListArray.from_arrays(ends, pa.array(query.astype(np.int32)))],
                ["id", "key", "queries"],
            )

    return blocks.select("ids", "keys", "sizes", "bits", "slices").mapInArrow(look, f"id {kind}, key bigint, queries array<int>")


def exact(rows: DataFrame, wanted: DataFrame, asked) -> DataFrame:
    """(query, id, key, score): scores above 0 of the wanted (id, key, queries), from the texts."""
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = asked.value
        number = {t: k for k, t in enumerate(a.terms)}
        for b in batches:
            out = []
            for j, (text, queries) in enumerate(zip(utf8(b.column(2)), b.column(3).to_pylist())):
                words = _TERM.findall(text.translate(_FOLD))
                if not words:
                    continue
                m = length_norm(len(words), a.docs, a.total)
                counts = np.zeros(len(a.terms), np.int64)
                for w in words:
                    k = number.get(w)
                    if k is not None:
                        counts[k] += 1
                tf = np.maximum(counts, 0)
                value = np.where(tf > 0, a.weights * gain(np.maximum(tf, 1), m), 0)
                for q in queries:
                    total = int(value[a.of[a.at[q] : a.at[q + 1]]].sum())
                    if total > 0:
                        out.append((q, j, total))
            found = np.array(out, np.int64).reshape(-1, 3)
            at = pa.array(found[:, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0].astype(np.int32)), b.column(0).take(at), b.column(1).take(at), pa.array(found[:, 2])],
                ["query", "id", "key", "score"],
            )

    own = wanted.withColumnsRenamed({"id": "wanted_id", "key": "wanted_key"})
    both = rows.join(own, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("key") == F.col("wanted_key")))
    return both.select("id", "key", "text", "queries").mapInArrow(score, f"query int, id {kind}, key bigint, score bigint")


def _asked(block: list, counts: dict[int, int], docs: int, total: int) -> Asked:
    terms = sorted({t.encode() for x in block for t in x["terms"]})
    hashes, _ = word_hashes(terms, ALNUM)
    df = [counts.get(h, 0) for h in hashes.view(np.int64).tolist()]
    held = [k for k, n in enumerate(df) if n]
    number = {terms[k]: j for j, k in enumerate(held)}
    lists = [[number[t.encode()] for t in x["terms"] if t.encode() in number] for x in block]
    return Asked(
        [terms[k] for k in held], hashes[held], np.array([term_weight(df[k], docs) for k in held], np.int64),
        np.array([j for x in lists for j in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), docs, total,
    )


def search(
    docs: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text",
    query_id_col: str = "item_id", query_text_col: str = "text", round_terms: int = ROUND_TERMS,
) -> DataFrame:
    """(query_id, rank, id, key, score): of every query the ``top`` documents by score, ties by id and text hash.

    Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. Every
    row is a document, repeated rows too; null ids come before others among equal scores. Null
    texts and texts without terms score nothing and count in no statistic. Queries with one id
    are one query with the terms of all; queries without terms, and an empty table of either
    kind, give no rows. Documents with a score of 0 are not listed. Queries are looked up in
    rounds of about ``round_terms`` terms, so what a task holds of them is bounded; each round
    reads the index twice, and of the documents only the texts to be scored are joined.
    """
    spark = docs.sparkSession
    blocks = index(docs, id_col, text_col)
    rows = packed(docs, id_col, text_col).select("id", F.col("text").cast("string").alias("text"))
    rows = rows.select("id", text_hash(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sums = blocks.agg(
        F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total")
    ).first()
    held, total = int(sums["docs"] or 0), int(sums["total"] or 0)
    text = F.translate(F.col(f"`{query_text_col}`").cast("string"), UPPER, LOWER)
    words = queries.select(
        F.col(f"`{query_id_col}`").alias("query_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")
    ).distinct()
    asked = stored(words.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms")))
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    rounds = max(1, -(-int(n_terms) // round_terms))
    out = []
    for r in range(rounds if held else 0):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).collect()
        terms = sorted({t.encode() for x in block for t in x["terms"]})
        if not terms:
            continue
        hashes = spark.createDataFrame([(h,) for h in word_hashes(terms, ALNUM)[0].view(np.int64).tolist()], "term bigint")
        vocabulary = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("v")).select(F.col("v.terms").alias("term"), F.col("v.dfs").alias("df"))
        df = vocabulary.join(hashes, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        queries_of_round = _asked(block, {x["term"]: x["df"] for x in df.collect()}, held, total)
        shared = spark.sparkContext.broadcast(queries_of_round)
        firsts = first_looks(blocks, shared, 2 * top)
        seeds = stored(firsts.groupBy("id", "key").agg(F.collect_set("query").alias("queries")))
        best = Window.partitionBy("query").orderBy(F.desc("score"))
        kth = exact(rows, seeds, shared).withColumn("r", F.row_number().over(best)).filter(F.col("r") == top)
        least = np.zeros(len(block))
        for x in kth.select("query", "score").collect():
            least[x["query"]] = x["score"]
        # equal rows may lie in several blocks
        each = not_excluded(blocks, shared, least).select("id", "key", F.explode("queries").alias("query"))
        wanted = stored(each.groupBy("id", "key").agg(F.collect_set("query").alias("queries")))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "key")
        ranked = exact(rows, wanted, shared).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        kind = queries.schema[query_id_col].dataType.simpleString()
        names = spark.createDataFrame([(k, x["query_id"]) for k, x in enumerate(block)], f"query int, query_id {kind}")
        out.append(stored(ranked).join(names, "query").select("query_id", "rank", "id", "key", "score"))
    if not out:
        return spark.createDataFrame([], "rank int, key bigint, score bigint").select(
            F.lit(None).cast(queries.schema[query_id_col].dataType).alias("query_id"), "rank",
            F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), "key", "score",
        )
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every
