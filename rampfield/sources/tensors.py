"""SNK2: compact export of scan products as dense tensors in blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENTS = 4096


def _cell(axes: dict[str, int]) -> Column:
    """Row-major index over the axes."""
    index = F.lit(0).cast("bigint")
    for name, size in axes.items():
        index = index * size + F.col(name)
    return index


def dense_blocks(
    rows: DataFrame, keys: Sequence[str], axes: dict[str, int], fields: Sequence[str], length: int | None = None,
    length_name: str = "sample", elements: int = ELEMENTS,
) -> DataFrame:
    """(keys, field, axis_order, shape, block, offset, values): every field as blocks of a tensor.

    ``axes`` gives the index columns and their sizes, the slowest first. With ``length`` the
    fields are arrays, which add a last axis; longer ones are cut and shorter ones filled with
    NULL. A block holds about ``elements`` elements from ``offset`` on. Every cell of the axes
    has its place, NULL where a key has no row for it; of several rows for a cell the smallest
    counts. Numbers and flags become DOUBLE. A key without any row has no blocks.
    """
    keys, inner = list(keys), length or 1
    cells, per_block = 1, max(1, elements // inner)
    for size in axes.values():
        cells *= size
    kind = "double" if length is None else "array<double>"
    own = rows.select(*keys, _cell(axes).alias("_cell"), *[F.col(f).cast(kind).alias(f"_f{j}") for j, f in enumerate(fields)])
    own = own.withColumns({"_block": F.floor(F.col("_cell") / per_block), "_own": F.lit(1)})
    # places for all cells, made from block numbers so that no array spans a scan
    blocks = -(-cells // per_block)
    places = rows.select(*keys).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    first = F.col("_block") * per_block
    last = F.least(first + per_block, F.lit(cells)) - 1
    places = places.select(
        *keys, F.explode(F.sequence(first, last)).alias("_cell"), *[F.lit(None).cast(kind).alias(f"_f{j}") for j in range(len(fields))],
        "_block", F.lit(0).alias("_own"),
    )
    entry = F.struct("_cell", "_own", *[f"_f{j}" for j in range(len(fields))])
    gathered = own.unionByName(places).groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(entry)).alias("_all"))

    def kept(e: Column, j: Column) -> Column:
        """Of a cell the first own row, or else its place."""
        before, after = F.get("_all", j - 1), F.get("_all", j + 1)
        starts_own = (e["_own"] == 1) & (before.isNull() | (before["_cell"] != e["_cell"]) | (before["_own"] == 0))
        alone = (e["_own"] == 0) & (after.isNull() | (after["_cell"] != e["_cell"]))
        return starts_own | alone

    chosen = gathered.select(*keys, "_block", F.explode(F.array(F.filter("_all", kept))).alias("_c"))

    def values(j: int) -> Column:
        column = F.col(f"_c._f{j}")
        if length is None:
            return column
        nothing = F.array_repeat(F.lit(None).cast("double"), length)
        return F.flatten(F.transform(column, lambda a: F.slice(F.concat(F.coalesce(a, nothing), nothing), 1, length)))

    order = ",".join([*axes] + ([length_name] if length else []))
    shape = [*axes.values()] + ([length] if length else [])
    listed = F.array(*[F.struct(F.lit(f).alias("field"), values(j).alias("values")) for j, f in enumerate(fields)])
    return chosen.select(*keys, "_block", F.explode(listed).alias("_e")).select(
        *keys, "_e.field", F.lit(order).alias("axis_order"), F.array(*[F.lit(n) for n in shape]).alias("shape"),
        F.col("_block").alias("block"), (F.col("_block") * per_block * inner).alias("offset"), "_e.values",
    )


def tensor_cells(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inverse: (keys, field, index, value) with the row-major index of every element."""
    return blocks.select(*keys, "field", "offset", F.posexplode("values").alias("_p", "value")).select(
        *keys, "field", (F.col("offset") + F.col("_p")).alias("index"), "value"
    )
