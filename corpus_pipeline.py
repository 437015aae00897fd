"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, benchmark leaks go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm import decontam, linededup, neardup, packing, toxicity
from voxmere.llm.common import cut, table, unused, without, written

#: None of the learned, sketched or packed stages can be told in SQL; tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; all columns stay as they are, one named score too. Rows that repeat an id or a text are judged each for itself."""
    score = unused(docs, "score")
    return toxicity.score_documents(spark, docs, sf_dir, out=score).where(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; documents of which nothing is left go as well, those that had none to begin with stay. The earlier of equal lines has the smaller id, then number."""
    cleaned = linededup.without_duplicate_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays; rows that repeat that id stay with it. Documents without words have no duplicates."""
    found = neardup.near_duplicates(docs, size=5, percent=80)
    return without(docs, "doc_id", cut(found.where("key <> component_id").select("key")), "key")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, word by word or paraphrased, go, with all rows of their id."""
    leaks = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, "doc_id", cut(leaks.select(F.col("doc_id").alias("leak")).distinct()), "leak")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 2048 tokens; a null or empty text is one token. Ids are distinct here, as they are in `documents`."""
    return packing.pack_documents(docs).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
