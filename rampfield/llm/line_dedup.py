"""Repeated lines, found with levelled sorted runs of line hashes.

Lines arrive in batches. Every batch is reduced to one row per line key, merge-anti-joined
with the runs kept so far, and split: keys never seen go into a run of first sightings,
the others into a run of repeats. A level that holds ``fanout`` runs is compacted into one
run of the next level. A key therefore lies in exactly one run of first sightings, so at the
end the repeats alone are totalled, and each first sighting takes what was found again for it
by one join; nothing is grouped over all keys. Runs can be saved and loaded, so that later
batches are joined with those of earlier days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import packed, stored, text_key

#: fixed values: the white space cut from both ends of a line, and the letters that are lower-cased
WHITE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased; lower() does the same for ASCII, and faster."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    key = F.btrim(line, F.lit(WHITE))
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def once(value: Column) -> Column:
    """The value behind a generator, so that the optimizer cannot copy it into each of its uses."""
    return F.explode(F.array(value))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs (h1, h2, n_docs, last) by level; ``first`` holds first sightings, ``again`` repeats."""

    def __init__(self, fanout: int = 2) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.fanout = fanout
        self.first: dict[int, list[DataFrame]] = {}
        self.again: dict[int, list[DataFrame]] = {}

    @staticmethod
    def _runs(levels: dict[int, list[DataFrame]]) -> list[DataFrame]:
        return [run for level in levels.values() for run in level]

    def _put(self, levels: dict[int, list[DataFrame]], run: DataFrame, level: int = 0) -> None:
        held = levels.setdefault(level, [])
        held.append(run)
        if len(held) >= self.fanout:
            levels[level] = []
            self._put(levels, stored(totals(_union(held)).sortWithinPartitions(*KEY)), level + 1)

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch (h1, h2, id, first) and returns its keys that no earlier batch had."""
        batch = lines.groupBy(*KEY).agg(
            F.sum(F.col("first").cast("bigint")).alias("n_docs"), F.max("id").alias("last")
        )
        known = self._runs(self.first)
        if not known:  # the very first batch
            run = stored(batch.sortWithinPartitions(*KEY))
            self._put(self.first, run)
            return run
        seen = _union([r.select(*KEY) for r in known]).withColumn("known", F.lit(True))
        split = stored(batch.join(seen, KEY, "left").withColumn("known", F.col("known").isNotNull()), "known")
        fresh = split.filter(~F.col("known")).drop("known")
        self._put(self.first, fresh)
        self._put(self.again, split.filter("known").drop("known"))
        return fresh

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, last) of all keys that at least ``min_docs`` documents hold."""
        first, again = _union(self._runs(self.first)), self._runs(self.again)
        if again:
            more = totals(_union(again)).withColumnsRenamed({"n_docs": "more", "last": "later"})
            # greatest passes over nulls
            first = first.join(more, KEY, "left").select(
                *KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last", "later").alias("last")
            )
        return first.filter(F.col("n_docs") >= min_docs)

    def save(self, path: str) -> None:
        """Writes all runs under ``path``, which must not exist."""
        for name, levels in (("first", self.first), ("again", self.again)):
            for level, runs in levels.items():
                for k, run in enumerate(runs):
                    run.write.parquet(f"{path}/{name}-{level}-{k}")

    @staticmethod
    def load(spark: SparkSession, path: str, fanout: int = 2) -> LineRuns:
        """The runs that were saved under ``path``."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        runs = LineRuns(fanout)
        for name in sorted(status.getPath().getName() for status in files.listStatus(folder)):
            kind, level, _ = name.split("-")
            levels = runs.first if kind == "first" else runs.again
            levels.setdefault(int(level), []).append(spark.read.parquet(f"{path}/{name}"))
        return runs


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))


def line_table(rows: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(batch, h1, h2, id, k1, k2, pos, first) of all lines whose key is long enough.

    ``first`` marks the first line of a document with that key, so that a document counts
    once however often it repeats a line.
    """
    keys = F.transform(lines_of(F.col("text")), line_key)
    sized = F.filter(
        F.transform(
            keys,
            lambda k, i: F.struct(
                F.xxhash64(k).alias("h1"), F.hash(k).alias("h2"), i.alias("pos"),
                (F.char_length(k) >= min_chars).alias("long"),
            ),
        ),
        lambda x: x["long"],
    )
    marked = rows.select("id", "k1", "k2", once(F.sort_array(sized)).alias("s")).select(
        "id", "k1", "k2",
        F.transform(
            "s",
            lambda x, i: F.struct(
                x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"),
                ((i == 0) | (F.get("s", i - 1)["h1"] != x["h1"]) | (F.get("s", i - 1)["h2"] != x["h2"])).alias("first"),
            ),
        ).alias("s"),
    )
    return marked.select(F.pmod("k1", F.lit(batches)).cast("int").alias("batch"), "id", "k1", "k2", F.inline("s"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
    min_docs: int = 3, batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """(row, id, n_lines, n_dropped, kept): every document without its repeated lines.

    A line goes if at least ``min_docs`` documents hold its key of at least ``min_chars``
    code points, except in the document with the largest id among them. Null ids count as
    the smallest; where all holders have null ids, or several share the largest, these keep the
    line. Null and empty texts have one empty line. Every input row is a document, repeated
    rows too; an empty table gives no rows. Extra columns stay inside ``row``.
    """
    rows = packed(docs, id_col, text_col).withColumns(text_key())
    lines = stored(line_table(rows, min_chars, batches), "batch")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    # a table of its own, so that the join below reads plain exchanges and can split a hot line
    repeated = stored(runs.repeated(min_docs))
    going = (
        lines.join(repeated, KEY)
        .filter(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("k1", "k2", "id").agg(F.collect_set("pos").alias("drop"))
        .withColumnRenamed("id", "drop_id")
    )
    parts = lines_of(F.col("text"))
    joined = rows.join(
        going.withColumnsRenamed({"k1": "d1", "k2": "d2"}),
        (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")) & F.col("id").eqNullSafe(F.col("drop_id")),
        "left",
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drop"))
    return joined.select("row", "id", "text", "drop", once(parts).alias("parts")).select(
        "row", "id", F.size("parts").cast("bigint").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("bigint").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")).alias("kept"),
    )
