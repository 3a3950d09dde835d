"""A corpus pipeline of the operators in rampfield.llm: STAGES in order, each written and reread.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampfield.llm.decontamination import contamination
from rampfield.llm.line_dedup import drop_repeated_lines
from rampfield.llm.ngram_join import similar_groups
from rampfield.llm.queries import held_out
from rampfield.llm.sentencepiece_nbest import encoded_digests
from rampfield.llm.storage import stored, text_key
from rampfield.llm.toxicity import toxicity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5, by a model of the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id"))
    scored = toxicity(docs.select(*COLUMNS), train(docs, labels))
    return scored.filter(F.col("score") < 0.5).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text, a null text without a loss stays null."""
    out = drop_repeated_lines(docs.select(*COLUMNS))
    same = F.col("n_dropped") == 0
    return out.select(
        F.col("row.doc_id"), F.when(same, F.col("row.text")).otherwise(F.col("kept")).alias("text"), "row.lang", "row.source",
        F.when(same, F.col("row.n_chars")).otherwise(F.char_length("kept")).cast("bigint").alias("n_chars"),
    )


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumns(text_key())


def matches(found: DataFrame) -> Column:
    """A document and what was found for its id and text."""
    return F.col("id").eqNullSafe(F.col("doc_id")) & (found["f1"] == F.col("k1")) & (found["f2"] == F.col("k2"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents the one with the smallest doc_id; documents without words all stay.

    Of rows with equal doc_id in one group a single one stays: the one whose text key is smallest.
    """
    groups = stored(similar_groups(docs).select("id", F.col("k1").alias("f1"), F.col("k2").alias("f2"), "comp"))
    first = groups.filter("comp is not null").groupBy("comp").agg(
        F.min(F.struct(F.col("id").isNull().alias("without"), "id", "f1", "f2")).alias("m")
    ).select("m.id", "m.f1", "m.f2")
    alone = groups.filter("comp is null").select("id", "f1", "f2").distinct()
    kept = stored(first.withColumn("group", F.lit(True)).union(alone.withColumn("group", F.lit(False))))
    joined = keyed(docs).join(kept, matches(kept))
    # equal rows: one of them stays in a group
    once = joined.filter("group").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return once.union(joined.filter(~F.col("group")).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = contamination(docs, bench).filter(F.col("n_hit") > 0)
    hit = stored(hit.select("id", F.col("k1").alias("f1"), F.col("k2").alias("f2")).distinct())
    return keyed(docs).join(hit, matches(hit), "left_anti").select(*COLUMNS)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentations of every document's text."""
    return encoded_digests(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("sentencepiece", segment),
]

#: toxicity scores and similarity groups are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
