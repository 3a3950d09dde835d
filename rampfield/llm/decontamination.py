"""Benchmark passages in training documents, found with a positional inverted index.

The index is a table of postings (term, document, position). Exact windows need those of the
two rarest terms of each window: the postings of the rarest one, shifted by its offset, give
possible starts; the shifted postings of the next rarest must agree; the remaining terms are
compared with the words that a posting carries from around it.

Near matches allow moved words and, in whole windows, an absent one. A match holds one of the
rarest terms of its window, so postings of all benchmark terms are made around the occurrences
of those, where at least as many different terms of the window occur as a match needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import packed, stored, text_key
from .words import ALNUM, U, utf8, word_hashes

SIZE = 10
#: words of the benchmark that one round over the documents looks up; more take more rounds
ROUND_WORDS = 1_000_000

SCANNED = (
    "id {id}, k1 bigint, k2 bigint, n_words bigint, "
    "postings array<struct<term:bigint,pos:int,around:array<bigint>>>"
)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def item_words(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id string, words array<bigint>) of items that have words."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            h, n = word_hashes(utf8(b.column(1)), ALNUM)
            flat = pa.array(_signed(h))
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["item_id", "words"])

    src = bench.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(read, "item_id string, words array<bigint>").filter(F.size("words") > 0)


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, terms): every window of ``size`` words, or the whole of a shorter item."""
    n = F.least(F.size("words"), F.lit(size))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1))
    return items.select("item_id", "words", n.alias("n"), at.alias("at")).select(
        "item_id", F.slice("words", F.col("at"), F.col("n")).alias("terms")
    ).distinct()


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, cf): occurrences over all documents of the given terms (sorted, unsigned)."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(terms), np.int64)
        for b in batches:
            h, _ = word_hashes(utf8(b.column(0)), ALNUM)
            k = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            total += np.bincount(k[terms[k] == h], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(terms[some])), pa.array(total[some])], ["term", "cf"])

    return docs.select("text").mapInArrow(count, "term bigint, cf bigint").groupBy("term").agg(F.sum("cf").alias("cf"))


def scan(rows: DataFrame, first: np.ndarray, second: np.ndarray, size: int, known: np.ndarray | None = None) -> DataFrame:
    """Every document with its number of words and its postings of the given terms.

    A posting of ``first`` carries the ``size - 1`` words before it and after it; if ``known``
    (sorted) is given, words other than those are zero.
    """
    wanted = np.union1d(first, second)

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pad = np.zeros(size - 1, U)
        for b in batches:
            h, n = word_hashes(utf8(b.column(3)), ALNUM)
            ends = np.cumsum(n)
            k = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            at = np.flatnonzero(wanted[k] == h) if len(wanted) else np.zeros(0, np.int64)
            doc = np.searchsorted(ends, at, side="right")
            start = (ends - n)[doc]
            near = np.isin(h[at], first)
            some = at[near]
            grid = some[:, None] + np.arange(1 - size, size)
            around = np.concatenate([pad, h, pad])[grid + size - 1]
            around[(grid < start[near][:, None]) | (grid >= ends[doc[near]][:, None])] = 0
            if known is not None and len(known):
                around[known[np.minimum(np.searchsorted(known, around), len(known) - 1)] != around] = 0
            bounds = np.concatenate([[0], np.cumsum(near * (2 * size - 1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(_signed(around.ravel())))
            post = pa.StructArray.from_arrays(
                [pa.array(_signed(h[at])), pa.array((at - start).astype(np.int32)), lists], ["term", "pos", "around"]
            )
            per_doc = np.concatenate([[0], np.searchsorted(at, ends)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n), pa.ListArray.from_arrays(pa.array(per_doc), post)],
                ["id", "k1", "k2", "n_words", "postings"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "k1", "k2", "text").mapInArrow(post, SCANNED.format(id=kind))


def _rarest(terms: list[int], counts: dict[int, int]) -> list[int]:
    """Offsets of the terms, rarest first, ties by offset."""
    return sorted(range(len(terms)), key=lambda k: (counts.get(terms[k], 0), k))


def _lookups(windows: list[list[int]], counts: dict[int, int]) -> list[tuple]:
    """(terms, first term, its offset, second term, its offset): rarest first, ties by offset."""
    out = []
    for terms in windows:
        order = _rarest(terms, counts)
        a, b = order[0], order[min(1, len(order) - 1)]
        out.append((terms, terms[a], a, terms[b], b))
    return out


def phrase_hits(postings: DataFrame, lookups: DataFrame, size: int = SIZE) -> DataFrame:
    """(k1, k2, start, n, terms): exact occurrences of the looked-up windows.

    ``postings`` (term, k1, k2, pos, around), ``lookups`` (terms, t1, o1, t2, o2).
    """
    rarest = postings.filter(F.col("around").isNotNull() & (F.size("around") > 0)).withColumnRenamed("term", "t1")
    starts = rarest.join(lookups, "t1").withColumn("p2", F.col("pos") - F.col("o1") + F.col("o2"))
    second = postings.select(F.col("term").alias("t2"), "k1", "k2", F.col("pos").alias("p2"))
    both = starts.join(second, ["t2", "k1", "k2", "p2"])
    same = F.slice("around", F.lit(size) - F.col("o1"), F.size("terms")) == F.col("terms")
    return both.filter(same).select(
        "k1", "k2", (F.col("pos") - F.col("o1")).alias("start"), F.size("terms").alias("n"), "terms"
    )


def proximity_hits(postings: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query, k1, k2, start): documents where the terms of a query occur near their places.

    ``queries`` (query, term, offset, rank) lists each query's terms, rank 1 the rarest;
    every other term must lie within ``slop`` positions of its offset from the rarest one's.
    With a further column ``spare``, so many terms of the query may be absent, the rarest too;
    starts are then taken from the ``spare + 1`` rarest.
    """
    spare = F.col("spare") if "spare" in queries.columns else F.lit(0)
    # tables, not aggregates, so that joins can split terms with many postings
    asked = stored(queries.groupBy("query").agg(
        F.collect_list(F.struct("rank", "term", "offset")).alias("terms"), F.max(spare).alias("spare")
    ))
    first = asked.select("query", "terms", "spare", F.explode("terms").alias("t")).filter("t.rank <= spare + 1")
    starts = first.withColumn("term", F.col("t.term")).join(postings.select("term", "k1", "k2", "pos"), "term").select(
        "query", "k1", "k2", (F.col("pos") - F.col("t.offset")).alias("start"), "terms", "spare"
    )
    # the places of a term fall into at most two cells
    cell = 2 * slop + 1
    place = F.col("start") + F.col("t.offset")
    left = (
        starts.withColumn("need", F.size("terms") - F.col("spare")).withColumn("t", F.explode("terms")).drop("terms", "spare")
        .withColumns({"term": F.col("t.term"), "rank": F.col("t.rank"), "place": place})
        .withColumn("cell", F.explode(F.array_distinct(F.array(*[F.floor((F.col("place") + d) / cell) for d in (-slop, slop)]))))
        .drop("t")
    )
    right = postings.select("term", "k1", "k2", "pos", F.floor(F.col("pos") / cell).alias("cell"))
    near = left.join(right, ["term", "k1", "k2", "cell"]).filter(F.abs(F.col("pos") - F.col("place")) <= slop)
    found = near.groupBy("query", "k1", "k2", "start", "need").agg(F.size(F.collect_set("rank")).alias("got"))
    return found.filter(F.col("got") >= F.col("need")).select("query", "k1", "k2", "start")


def near_hits(postings: DataFrame, windows: DataFrame, size: int, slop: int, missing: int) -> DataFrame:
    """(k1, k2, terms): texts in which a window occurs with its words near their places.

    ``postings`` as for ``phrase_hits``, those of the ``missing + 1`` rarest terms with the
    ``size - 1 + slop`` words before and after them; ``windows`` (query, terms, order), the
    offsets in ``order`` rarest first.
    """
    reach = size - 1 + slop
    asked = windows.withColumn("spare", F.when(F.size("terms") == size, F.lit(missing)).otherwise(F.lit(0)))
    pivots = asked.select("query", "terms", "spare", F.explode(F.expr("slice(order, 1, spare + 1)")).alias("at")).select(
        "query", "terms", "spare", F.element_at("terms", F.col("at") + 1).alias("term")
    ).distinct()
    need = F.size(F.array_distinct("terms")) - F.col("spare")
    some = stored(
        postings.filter(F.col("around").isNotNull() & (F.size("around") > 0)).join(stored(pivots), "term")
        .filter(F.size(F.array_intersect("around", "terms")) >= need).select("query", "k1", "k2", "pos", "around")
    )
    words = stored(
        some.select("k1", "k2", "pos", "around").distinct()
        .select("k1", "k2", F.col("pos").alias("mid"), F.posexplode("around").alias("at", "term")).filter("term <> 0")
        .select("term", "k1", "k2", (F.col("mid") + F.col("at") - reach).alias("pos")).distinct()
    )
    terms = asked.join(some.select("query").distinct(), "query").select(
        "query", "spare", "terms", F.posexplode("order").alias("rank", "offset")
    ).select("query", "spare", F.element_at("terms", F.col("offset") + 1).alias("term"), "offset", (F.col("rank") + 1).alias("rank"))
    found = proximity_hits(words, terms, slop).select("query", "k1", "k2").distinct()
    return found.join(windows.select("query", "terms"), "query").select("k1", "k2", "terms")


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, round_words: int = ROUND_WORDS,
    slop: int | None = None, missing: int = 1,
) -> DataFrame:
    """(id, k1, k2, n_words, n_hit, items): every document with its words inside benchmark windows.

    ``k1, k2`` identify the text (``storage.text_key``). ``items`` holds the ids, sorted as
    strings, of the items of which a window occurs. Null and
    empty texts have no words; items without words match nothing; equal item ids count once
    and an item without id marks words but is not listed. Repeated rows each get the same
    result. The benchmark is looked up in rounds of at most ``round_words`` words, so what
    a task holds of it is bounded; each round reads the documents.

    With ``slop`` there is a further column ``near_items``: the items of which a window occurs
    with its words at most ``slop`` positions from their places, counted from one of its rarest
    words. Up to ``missing`` words of a window of ``size`` words may be absent or changed; all
    words of a shorter item are needed. Exact occurrences are near ones too.
    """
    spark = docs.sparkSession
    rows = packed(docs, id_col, text_col).select("id", F.col("text").cast("string").alias("text")).withColumns(text_key())
    items = stored(item_windows(item_words(bench, item_id_col, item_text_col), size))
    windows = items.select("terms").distinct()
    n_words = windows.agg(F.sum(F.size("terms"))).first()[0] or 0
    rounds = max(1, -(-int(n_words) // round_words))
    part = F.pmod(F.xxhash64("terms"), F.lit(rounds))
    reach = size if slop is None else size + slop
    base, hits, near = None, [], []
    for r in range(rounds):
        block = [x["terms"] for x in windows.filter(part == r).select("terms").collect()]
        terms = np.unique(np.array([t for w in block for t in w], np.int64).view(U))
        counts = {x["term"]: x["cf"] for x in term_counts(rows, terms).collect()} if len(terms) else {}
        found = _lookups(block, counts)
        first = np.unique(np.array([x[1] for x in found], np.int64).view(U))
        second = np.unique(np.array([x[3] for x in found], np.int64).view(U))
        if slop is None:
            scanned = stored(scan(rows, first, second, size))
        else:
            ranked = [(k, w, _rarest(w, counts)) for k, w in enumerate(block)]
            some = [w[o] for _, w, order in ranked for o in order[: missing + 1]]
            first = np.union1d(first, np.unique(np.array(some, np.int64).view(U)))
            scanned = stored(scan(rows, first, second, reach, terms))
        base = scanned if base is None else base
        lookups = spark.createDataFrame(found, "terms array<bigint>, t1 bigint, o1 int, t2 bigint, o2 int")
        postings = (
            scanned.select("k1", "k2", F.inline("postings"))
            .groupBy("term", "k1", "k2", "pos").agg(F.first("around").alias("around"))
        )
        postings = stored(postings)
        hits.append(phrase_hits(postings, lookups, reach))
        if slop is not None:
            asked = spark.createDataFrame(ranked, "query int, terms array<bigint>, order array<int>")
            near.append(near_hits(postings, asked, size, slop, missing))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    every = stored(every)
    spans = every.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("s")).select(
        "k1", "k2",
        F.aggregate(
            "s", F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).alias("upto")),
            lambda acc, x: F.struct(
                (acc["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(x["start"], acc["upto"]))).alias("hit"),
                F.greatest(acc["upto"], x["start"] + x["n"]).alias("upto"),
            ),
            lambda acc: acc["hit"],
        ).alias("n_hit"),
    )

    def listing(hits: DataFrame, name: str) -> DataFrame:
        return (
            hits.select("k1", "k2", "terms").distinct().join(items, "terms")
            .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias(name))
        )

    found = spans.join(listing(every, "items"), ["k1", "k2"], "left")
    lists = ["items"]
    if slop is not None:
        close = near[0]
        for h in near[1:]:
            close = close.unionByName(h)
        found = found.join(listing(close, "near_items"), ["k1", "k2"], "full")
        lists.append("near_items")
    # a table of its own, so that the join below reads plain exchanges and can split copies of one text
    result = stored(found)
    return base.select("id", "k1", "k2", "n_words").join(result, ["k1", "k2"], "left").select(
        "id", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists],
    )
