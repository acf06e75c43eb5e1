"""A corpus from raw documents to packed sequences: STAGES are applied in order, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.llm import decontam, line_dedup, ngram_join, packing, toxicity
from sparkatlas.llm.common import shared_dir
from sparkatlas.llm.queries import table, vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this stage's input and the labels, rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; a document that had nothing else goes as a whole."""
    out = line_dedup.drop_recurring_lines(docs)
    out = out.where("n_dropped = 0 OR trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies stays: five-word shingles, similarity 0.8."""
    return ngram_join.drop_near_copies(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096."""
    return packing.pack_documents(docs, vocabulary(), chunk_tokens=1_000_000, remember=False)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("ngram_join", near_copies), ("decontamination", leaks), ("packing", packed)]
#: SQL expresses neither the learned toxicity model nor the tokenizer; the tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
