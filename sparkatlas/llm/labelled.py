"""The bounded training sample of labelled documents that the two classifiers fit on."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Training documents read at most; those of the smallest hash of doc_id are taken.
SAMPLE_ROWS = 16_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def remainder_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents that aren't held out, written once.

    Labels other than 0 and 1 and null ids don't count; of several labels of one id the largest does.
    """
    fit = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    fit = fit.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = cut(fit.coalesce(1), "fit")
    return cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]), "sample")
