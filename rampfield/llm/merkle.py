"""A hash tree over a table, stored in blocks with a van Emde Boas layout.

Rows become leaves in the order of their id inside their group; every run of three nodes has
their hash as parent. A whole tree is cut into aligned subtrees of ``block_levels`` levels: one
row of a stage table each. Their roots are the leaves of the next stage, and the roots of all
groups are the leaves of one last tree. Inside a block the nodes lie in the order of a
recursive split at half height: the upper half of the levels first, then the subtrees below it
one after the other, each laid out the same way. A node's place follows from its level and
index alone, for building as for finding siblings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

ARITY = 3
STEPS = "array<struct<before:string,after:string>>"
BLOCK = "g string, block bigint, n bigint, levels int, k int, nodes binary, root string"


def field(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value as text; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# --- layout --------------------------------------------------------------------------


def tree_size(levels: int) -> int:
    """Nodes of a whole tree with so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` below the root of a whole tree."""
    if levels == 1:
        return np.zeros_like(index)
    below = levels // 2
    above = levels - below
    if depth < above:
        return address(above, depth, index)
    width = ARITY ** (depth - above)
    return tree_size(above) + index // width * tree_size(below) + address(below, depth - above, index % width)


@lru_cache(maxsize=64)
def layout(levels: int, k: int) -> list[np.ndarray]:
    """Places by level, leaves first, in a tree of ``levels`` steps over ``k`` leaves.

    Nodes that such a tree lacks leave no holes: the others move up in order.
    """
    count, places = k, []
    for step in range(levels + 1):
        places.append(address(levels + 1, levels - step, np.arange(count)))
        count = -(-count // ARITY)
    used = np.sort(np.concatenate(places))
    return [np.searchsorted(used, p) for p in places]


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def laid_out(leaves: list[str], levels: int) -> tuple[bytes, str]:
    """(all nodes of the block by place, its root)."""
    places = layout(levels, len(leaves))
    nodes = np.zeros((sum(map(len, places)), 32), np.uint8)
    level = leaves
    for step, at in enumerate(places):
        nodes[at] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        if step < levels:
            level = [digest(level[j : j + ARITY]) for j in range(0, len(level), ARITY)]
    return nodes.tobytes(), level[0]


def siblings(nodes: bytes, levels: int, k: int) -> list[tuple[list[str], list[str]]]:
    """By level: what stands before and what stands behind each node in its run."""
    text = nodes.hex()
    out = []
    for at in layout(levels, k)[:levels]:
        level = [text[64 * p : 64 * p + 64] for p in at.tolist()]
        before = ["".join(level[j - j % ARITY : j]) for j in range(len(level))]
        after = ["".join(level[j + 1 : j - j % ARITY + ARITY]) for j in range(len(level))]
        out.append((before, after))
    return out


def paths(nodes: bytes, levels: int, k: int, tail: list[dict]):
    """Arrow list array: the steps from every leaf of a block to its root, then ``tail``."""
    import pyarrow as pa

    found = siblings(nodes, levels, k)
    tail_before, tail_after = [s["before"] for s in tail], [s["after"] for s in tail]
    before: list[str] = []
    after: list[str] = []
    for leaf in range(k):
        at = leaf
        for b, a in found:
            before.append(b[at])
            after.append(a[at])
            at //= ARITY
        before += tail_before
        after += tail_after
    ends = np.arange(k + 1, dtype=np.int32) * (levels + len(tail))
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
    )


# --- order ---------------------------------------------------------------------------


def _numbered(batches: Iterator) -> Iterator:
    """Adds (part, pos): the task, and the place inside the group in this task."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, last, upto = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        ends = np.asarray(runs.run_ends)
        starts = np.concatenate([[0], ends[:-1]])
        places = np.arange(b.num_rows, dtype=np.int64)
        for value, start, end in zip(runs.values.to_pylist(), starts.tolist(), ends.tolist()):
            if value != last:
                last, upto = value, 0
            places[start:end] += upto - start
            upto += end - start
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(places)], [*b.schema.names, "part", "pos"]
        )


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds (n, rank): rows of the group ``g``, and the place among them in the order.

    Range partitions number their rows; counts by group and partition, of which there are no
    more than partitions and groups together, give what lies before a partition.
    """
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    parts = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    numbered = stored(parts.mapInArrow(_numbered, f"{kinds}, part int, pos bigint"))
    by = Window.partitionBy("g")
    counts = numbered.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c"))
    before = stored(counts.select(
        "g", "part", F.sum("c").over(by).alias("n"),
        (F.sum("c").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("first"),
    ))
    return numbered.join(before, ["g", "part"]).withColumn("rank", F.col("first") + F.col("pos")).drop("part", "pos", "first")


# --- trees ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees of many groups: ``leaves`` (g, n, rank, node, ...) and their stages of blocks."""

    leaves: DataFrame
    stages: list[DataFrame]
    per_block: int

    def roots(self) -> DataFrame:
        """(g, root) of every group."""
        out = None
        for s in self.stages:
            own = s.filter(F.col("n") <= self.per_block).select("g", "root")
            out = own if out is None else out.union(own)
        return out


def _blocks(block_levels: int) -> Callable:
    per_block = ARITY**block_levels

    def build(table):
        import pyarrow as pa

        slots = np.asarray(table["rank"]) % per_block
        nodes = table["node"].to_pylist()
        leaves = [nodes[j] for j in np.argsort(slots).tolist()]
        n = table["n"][0].as_py()
        levels = block_levels
        if n <= per_block:
            levels = next(x for x in range(block_levels + 1) if ARITY**x >= n)
        laid, root = laid_out(leaves, levels)
        return pa.table({
            "g": table["g"][:1], "block": table["block"][:1], "n": table["n"][:1], "levels": pa.array([levels], pa.int32()),
            "k": pa.array([len(leaves)], pa.int32()), "nodes": pa.array([laid], pa.binary()), "root": [root],
        })

    return build


def forest(leaves: DataFrame, block_levels: int) -> Forest:
    """Trees over ``leaves`` (g, n, rank, node): a stage of blocks, then one over their roots, and so on."""
    per_block, stages = ARITY**block_levels, []
    rows = leaves.select("g", "n", "rank", "node")
    while True:
        cut = rows.withColumn("block", F.floor(F.col("rank") / per_block))
        stage = stored(cut.groupBy("g", "block").applyInArrow(_blocks(block_levels), BLOCK))
        stages.append(stage)
        more = stage.filter(F.col("n") > per_block)
        if more.isEmpty():
            return Forest(leaves, stages, per_block)
        rows = more.select(
            "g", F.ceil(F.col("n") / per_block).alias("n"), F.col("block").alias("rank"), F.col("root").alias("node")
        )


def _children(per_block: int) -> Callable:
    def expand(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                k = row["k"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["g"]] * k, pa.string()), pa.array(row["block"] * per_block + np.arange(k)),
                        pa.array([row["top"]] * k, pa.string()), pa.array([row["whole"]] * k, pa.string()),
                        paths(row["nodes"], row["levels"], k, row["steps"]),
                    ],
                    ["g", "block", "top", "whole", "steps"],
                )

    return expand


def _leaf_paths(names: list[str]) -> Callable:
    def find(leaves, blocks):
        import pyarrow as pa

        if not leaves.num_rows or not blocks.num_rows:
            return pa.table({n: leaves[n] for n in names} | {
                "top": pa.array([], pa.string()), "whole": pa.array([], pa.string()),
                "steps": pa.array([], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
            })
        block = blocks.to_pylist()[0]
        found = paths(block["nodes"], block["levels"], block["k"], block["steps"])
        slots = np.asarray(leaves["slot"])
        return pa.table({n: leaves[n] for n in names} | {
            "top": pa.array([block["top"]] * len(slots), pa.string()), "whole": pa.array([block["whole"]] * len(slots), pa.string()),
            "steps": found.take(pa.array(slots)),
        })

    return find


def leaf_paths(trees: Forest, tops: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` of every leaf with (top, whole, steps): the way from it to the root of all.

    ``tops`` (g, top, whole, steps) says how each group goes on from its root. Stages are gone
    through from the last to the first, by block; leaves meet their own block only.
    """
    known: DataFrame | None = None
    for level in range(len(trees.stages) - 1, -1, -1):
        stage = trees.stages[level]
        ends = stage.filter(F.col("n") <= trees.per_block).join(tops, "g")
        inner = None if known is None else stage.filter(F.col("n") > trees.per_block).join(known, ["g", "block"])
        columns = ["g", "block", "levels", "k", "nodes", "top", "whole", "steps"]
        with_steps = ends.select(*columns) if inner is None else ends.select(*columns).unionByName(inner.select(*columns))
        if level:
            kinds = f"g string, block bigint, top string, whole string, steps {STEPS}"
            known = stored(with_steps.mapInArrow(_children(trees.per_block), kinds))
        else:
            own = trees.leaves.select(
                "g", F.floor(F.col("rank") / trees.per_block).alias("block"),
                (F.col("rank") % trees.per_block).cast("int").alias("slot"), *keep,
            )
            kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
            return own.groupBy("g", "block").cogroup(with_steps.groupBy("g", "block")).applyInArrow(
                _leaf_paths(list(keep)), f"{kinds}, top string, whole string, steps {STEPS}"
            )
    raise ValueError("a forest has at least one stage")


# --- the manifest --------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """``rows``: trees over the rows of every group; ``groups``: the one tree over their roots."""

    rows: Forest
    groups: Forest

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.groups.roots().select("root")


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    presented: dict[str, Column] | None = None, block_levels: int = 6,
) -> Manifest:
    """The hash tree of a table.

    A leaf is the digest of ``columns``. Inside a group leaves ascend by id, null first; rows
    with one id by their digest, so that equal rows are equal leaves side by side. A null group
    is a group of its own, before all others, which ascend by the bytes of their text.
    ``presented`` names columns with what somebody shows instead of the stored value; the leaf
    so changed is kept as ``claim``. Long texts are only ever hashed; an empty table has no
    blocks and no root. Other columns have no part in it, whatever their names.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    source = F.col(f"`{group_col}`").cast("string")
    # one row for each leaf; "salt" spreads equal rows over range partitions
    leaves = stored(docs.select(
        F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("g"), F.col(f"`{id_col}`").alias("id"),
        row_digest(list(values.values())).alias("node"),
        row_digest(list((values | (presented or {})).values())).alias("claim"), F.monotonically_increasing_id().alias("salt"),
    ))
    rows = forest(stored(ranked(leaves, ["id", "node", "salt"])), block_levels)
    tops = stored(rows.roots().select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node")))
    return Manifest(rows, forest(stored(ranked(tops, ["name"])), block_levels))


def proofs(tree: Manifest) -> DataFrame:
    """(id, leaf, claim, subroot, root, steps) of every row.

    ``steps`` leads from the leaf to the root: the siblings before and behind it, level by
    level. ``fold`` applied to it gives the root again.
    """
    start = tree.groups.roots().select("g", F.col("root").alias("top"), F.col("root").alias("whole"), F.array().cast(STEPS).alias("steps"))
    groups = leaf_paths(tree.groups, start, ["name", "node"])
    # the groups' own paths: top is now the root of the group
    tops = stored(groups.select(F.col("name").alias("g"), F.col("node").alias("top"), "whole", "steps"))
    found = leaf_paths(tree.rows, tops, ["id", "node", "claim"])
    return found.select(
        "id", F.col("node").alias("leaf"), "claim", F.col("top").alias("subroot"), F.col("whole").alias("root"), "steps"
    )


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings from the leaf to the root, left to right on each level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)
