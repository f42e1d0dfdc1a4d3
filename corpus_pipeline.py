"""Corpus cleaning as a chain of stages; each stage's rows are written as Parquet and read again as the next one's documents.

Every stage keeps extra columns, takes null ids and texts, and gives an empty table for an empty one. Repeated rows stay until
``near_copies``, which makes them one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.llm import bpe, decontamination, line_dedup, ngram_join, quality_classifier
from pairloom.llm.common import saved, shared_dir, small
from pairloom.llm.entries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject; null and empty texts have the score of an empty passage."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return quality_classifier.score(docs, model, keep=rest).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows removed from texts; a text that loses all its lines goes; null texts and texts without lines stay."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component at similarity 0.8 of five-word shingles.

    Rows of one id are one document: its different texts all stay or go, and of rows equal in id and text one stays. Rows
    without an id can't be told apart by the join; of those, equal texts become one.
    """
    of = ngram_join.join_components(docs, n=5, percent=80)
    others = saved(of.where("component_id <> doc_id").select("doc_id").distinct(), "others")
    left = docs.join(small(others, ngram_join.MOST_BROADCAST), "doc_id", "left_anti").select(*docs.columns)
    mark = [F.col("doc_id").alias("d0"), F.xxhash64("text").alias("x0")]
    again = saved(left.select(*mark).groupBy("d0", "x0").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
    if again.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("d0")) & (F.xxhash64("text") == F.col("x0"))
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    by = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(*rest)
    one = left.join(again, same, "left_semi").withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    return left.join(again, same, "left_anti").unionByName(one)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten benchmark words (of a shorter item: without the item); null texts stay."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the remaining texts, null ones as empty; the last stage returns the digests instead of the columns of documents."""
    return bpe.encode_decode(docs, vocabulary())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the trained classifier nor the encoder; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
