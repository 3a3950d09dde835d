"""Similarity join on word shingles with a token-group matrix.

1. Every document becomes a set of shingle hashes. Equal sets are one set from then on.
2. A set with so many tokens that occur nowhere else that no other set can reach the
   threshold has no partner. That is counted on the tokens below a fixed hash value, the
   same for all sets, so the count is a lower bound and the rule exact.
3. The remaining sets are linked to the leaders of their min-hash buckets where they are
   really similar: one comparison for each set and bucket, however large the bucket.
4. Links between different components of step 3 are all found by the token-group matrix:
   similar sets form groups of bounded size, a group keeps the union of its members'
   tokens, a set is sent to the groups that hold a token of its prefix, and a group is opened
   for it only if the overlap with the union reaches what the threshold needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import packed, stored, text_key
from .words import VISIBLE, U, mix, utf8, windows, word_hashes

SIZE, PERCENT = 5, 80
#: share of the hash range whose tokens decide whether a set can have partners
LOW_SHARE = 0.3
SEEDS = np.random.default_rng(6).integers(1, 2**63, 4, dtype=np.int64).view(U)
#: tokens in a group of the matrix, and in the queries that meet it in one task
GROUP_TOKENS, QUERY_TOKENS = 200_000, 1_000_000


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, n = word_hashes(texts, VISIBLE)
    w = windows(h, size)
    at = 0
    for k in n.tolist():
        if k >= size:
            yield np.unique(w[at : at + k - size + 1])
        elif k:
            yield windows(h[at : at + k], k)
        else:
            yield np.zeros(0, U)
        at += k


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _set_id(tokens: np.ndarray) -> int:
    return int((mix(tokens).sum(dtype=U) + U(len(tokens))).view(np.int64))


def set_table(rows: DataFrame, size: int, low_share: float) -> DataFrame:
    """(id, k1, k2, sid, n, low): each document's set id, size and tokens below the hash limit."""
    limit = U(int(low_share * 2**64))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = list(shingle_sets(utf8(b.column(3)), size))
            low = _lists([s[: np.searchsorted(s, limit)] for s in sets])
            sid = pa.array([_set_id(s) for s in sets], pa.int64())
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), sid, n, low], ["id", "k1", "k2", "sid", "n", "low"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "k1", "k2", "text").mapInArrow(
        read, f"id {kind}, k1 bigint, k2 bigint, sid bigint, n bigint, low array<bigint>"
    )


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """(sid, n, tokens, keys): whole sets with one min-hash per seed."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [s for s in shingle_sets(utf8(b.column(0)), size) if len(s)]
            keys = [np.array([mix(s ^ seed).min() for seed in SEEDS], U) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 _lists(sets), _lists(keys)],
                ["sid", "n", "tokens", "keys"],
            )

    return rows.select("text").mapInArrow(read, "sid bigint, n bigint, tokens array<bigint>, keys array<bigint>")


def prefix(n: Column, percent: int) -> Column:
    """With so many tokens outside another set, a set of n cannot reach the threshold with it."""
    return n - F.ceil(n * percent / 100) + 1


def star_links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links a, b; groups sid, leader): verified links to bucket leaders, and each set's first leader."""
    keyed = sets.select("sid", F.posexplode("keys").alias("seed", "key"))
    leaders = keyed.groupBy("seed", "key").agg(F.min("sid").alias("leader"))
    pairs = stored(keyed.join(leaders, ["seed", "key"]).select("sid", "leader").distinct())
    groups = pairs.groupBy("sid").agg(F.min("leader").alias("leader"))
    s = sets.select("sid", "n", "tokens")
    lead = s.withColumnsRenamed({"sid": "leader", "n": "m", "tokens": "other"})
    sized = pairs.filter("sid <> leader").join(s, "sid").join(lead, "leader")
    common = F.size(F.array_intersect("tokens", "other")).cast("bigint")
    links = (
        sized.filter((100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n")))
        .withColumn("c", common)
        .filter(100 * F.col("c") >= percent * (F.col("n") + F.col("m") - F.col("c")))
        .select(F.col("leader").alias("a"), F.col("sid").alias("b"))
    )
    return stored(links), groups


def _outside(tokens: DataFrame, percent: int, sizes: DataFrame) -> DataFrame:
    """Sets of ``tokens`` (sid, token, comp) that could still have a partner in another component.

    ``sizes`` (sid, n, have): have counts the set's rows in ``tokens``.
    """
    shared = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    cross = tokens.join(shared, "token").groupBy("sid").agg(F.count("*").alias("cross"))
    return sizes.join(cross, "sid").filter(F.col("have") - F.col("cross") < prefix(F.col("n"), percent)).select("sid")


def cross_links(sets: DataFrame, percent: int, low_share: float) -> DataFrame:
    """(a, b): links that join all components of ``sets`` (sid, n, tokens, comp, leader) that have any.

    For every group it returns links that join all components which links of its members join.
    """
    limit = int(low_share * 2**64) - 2**64 * (low_share >= 0.5)
    # tokens are unsigned: those with the top bit set are negative here
    low = F.filter("tokens", lambda t: (t >= 0) & (t < limit) if low_share < 0.5 else (t >= 0) | (t < limit))
    some = sets.select("sid", "comp", "n", low.alias("low"))
    open_ = stored(
        _outside(some.select("sid", "comp", F.explode("low").alias("token")), percent,
                 some.select("sid", "n", F.size("low").alias("have")))
        # a set without low tokens is undecided as well
        .union(some.filter((F.size("low") < prefix(F.col("n"), percent))).select("sid")).distinct()
    )
    left = stored(sets.join(open_, "sid"))
    tokens = left.select("sid", "comp", F.explode("tokens").alias("token"))
    still = stored(_outside(tokens, percent, left.select("sid", "n", F.col("n").alias("have"))))
    left = stored(left.join(still, "sid"))

    weight = left.groupBy("comp").agg(F.count("*").alias("weight"))
    blocks = left.groupBy("leader").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("blocks"))
    placed = stored(
        left.join(weight, "comp").join(blocks, "leader")
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
        .select("sid", "n", "tokens", "leader", "block", F.struct("weight", "comp").alias("side"))
    )
    each = placed.select("sid", "n", "leader", "block", "side", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(
        F.count("*").alias("df"), F.min("side").alias("lo"), F.max("side").alias("hi")
    ).filter("lo <> hi")
    cross = stored(each.join(seen, "token").select("sid", "n", "leader", "block", "side", "token", "df"))
    count = cross.groupBy("sid").agg(F.count("*").alias("cross"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("sid").orderBy("df", "token"))
    lead = stored(
        cross.withColumn("rank", rank).join(count, "sid")
        .filter(F.col("rank") <= prefix(F.col("n"), percent) - (F.col("n") - F.col("cross")))
    )
    matrix = lead.groupBy("token", "leader", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("side").alias("top")
    )
    asked = (
        lead.select("sid", "n", "side", "token").join(matrix, "token")
        .filter(
            (F.col("side") < F.col("top")) & (100 * F.col("most") >= percent * F.col("n"))
            & (percent * F.col("least") <= 100 * F.col("n"))
        )
        .select("sid", "n", "leader", "block").distinct()
    )
    asked = stored(asked)
    chunks = asked.groupBy("leader", "block").agg(F.ceil(F.sum("n") / QUERY_TOKENS).alias("chunks"))
    queries = (
        asked.select("sid", "leader", "block").join(chunks, ["leader", "block"])
        .withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")))
        .join(placed.select("sid", "n", "tokens", "side"), "sid")
        .select(
            "leader", "block", "chunk", F.col("sid").alias("q_sid"), F.col("n").alias("q_n"),
            F.col("tokens").alias("q_tokens"), F.col("side.weight").alias("q_weight"), F.col("side.comp").alias("q_comp"),
        )
    )
    members = (
        placed.join(chunks, ["leader", "block"])
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .select("leader", "block", "chunk", "sid", "n", "tokens", "side.weight", "side.comp")
    )
    key = ["leader", "block", "chunk"]
    found = members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(
        lambda a, b: open_group(a, b, percent), "a bigint, b bigint"
    )
    return stored(found)


def open_group(members, queries, percent: int):
    """Links between queries and members that join all components which any of their links joins.

    A link whose ends are joined by earlier ones is not needed; so there are fewer links than
    members and queries together.
    """
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    def flat(table, mark=""):
        lists = table[f"{mark}tokens"].combine_chunks()
        columns = [table[mark + c].to_numpy() for c in ("sid", "n", "weight", "comp")]
        return lists.flatten().to_numpy().view(U), columns

    out_a, out_b = [], []
    if members.num_rows and queries.num_rows:
        tokens, (sid, n, weight, comp) = flat(members)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(tokens, kind="stable")
        union, first = np.unique(tokens[order], return_index=True)
        owner, ends = owner[order], np.append(first[1:], len(tokens))
        asked, (qsid, qn, qweight, qcomp) = flat(queries, "q_")
        at = 0
        for k, size in enumerate(qn.tolist()):
            q = asked[at : at + size]
            at += size
            where = np.minimum(np.searchsorted(union, q), len(union) - 1)
            where = where[union[where] == q]
            if 100 * len(where) < percent * size:
                continue  # the union bound: no member can share enough
            lens = ends[where] - first[where]
            cells = np.repeat(first[where] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            common = np.bincount(owner[cells], minlength=len(n))
            larger = (weight > qweight[k]) | ((weight == qweight[k]) & (comp > qcomp[k]))
            hit = np.flatnonzero(larger & (100 * common >= percent * (n + size - common)))
            hit = hit[np.unique(comp[hit], return_index=True)[1]]
            mine = root(int(qcomp[k]))
            for m in hit.tolist():
                other = root(int(comp[m]))
                if other != mine:
                    parent[other] = mine
                    out_a.append(int(qsid[k]))
                    out_b.append(int(sid[m]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
    percent: int = PERCENT, low_share: float = LOW_SHARE,
) -> DataFrame:
    """(id, k1, k2, n, comp, first): every row with its set size, its component's set id and smallest id.

    Two documents are linked when 100 * intersection >= percent * union of their sets.
    Null, empty and wordless texts have empty sets: they are linked to nothing (comp null)
    and ``first`` is their own id. A row without id takes part; ``first`` is the smallest id
    that is not null, or null if there is none. Equal rows are linked like equal texts.
    """
    rows = packed(docs, id_col, text_col).select("id", F.col("text").cast("string").alias("text")).withColumns(text_key())
    table = stored(set_table(rows, size, low_share))
    sets = table.filter("n > 0").groupBy("sid", "n").agg(F.min(F.struct("k1", "k2")).alias("k"))
    owner = (
        table.filter("n > 0").select("sid", F.explode("low").alias("token")).groupBy("token")
        .agg(F.min("sid").alias("sid"), F.max("sid").alias("hi")).filter("sid = hi")
    )
    alone = owner.groupBy("sid").agg(F.count("*").alias("alone"))
    kept = stored(
        sets.join(alone, "sid", "left")
        .filter(F.coalesce("alone", F.lit(0)) < prefix(F.col("n"), percent)).select("k.k1", "k.k2")
    )
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(kept, ["k1", "k2"])
    full = stored(full_sets(texts, size))
    links, groups = star_links(full, percent)
    label = components(links)
    near = full.select("sid", "n", "tokens").join(label.withColumnRenamed("node", "sid"), "sid", "left").join(groups, "sid")
    near = stored(near.withColumn("comp", F.coalesce("comp", "sid")))
    more = cross_links(near, percent, low_share)
    final = components(links.union(more))
    placed = table.select("id", "k1", "k2", "sid", "n").join(final.withColumnRenamed("node", "sid"), "sid", "left").select(
        "id", "k1", "k2", "n", F.when(F.col("n") > 0, F.coalesce("comp", "sid")).alias("comp")
    )
    placed = stored(placed)
    # a table of its own, so that the join can split a large component
    firsts = stored(placed.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("first")))
    return placed.join(firsts, "comp", "left").select(
        "id", "k1", "k2", "n", "comp", F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("first")).alias("first")
    )
