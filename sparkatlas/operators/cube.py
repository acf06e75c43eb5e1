"""Counts of symbols by all groupings of their kinds, and distinct names by sketches that can be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's buckets: about 0.8 % standard error, at most 16 kB.
BUCKETS = 14


def cube(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(language, kind, is_exported, level, symbols, names): every grouping in one pass; ``level`` has a bit for each column
    that is summed over, which tells its null from a null value."""
    x = symbols.join(files.select(F.col("id").alias("file_id"), "language"), "file_id")
    return x.cube("language", "kind", "is_exported").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("symbols"), F.countDistinct("name").alias("names")).select("language", "kind", "is_exported", "level", "symbols", "names")


def sketches(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(language, kind, symbols, names): a sketch of the distinct names of each finest group, to be stored."""
    x = symbols.join(files.select(F.col("id").alias("file_id"), "language"), "file_id")
    return x.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.hll_sketch_agg("name", F.lit(BUCKETS)).alias("names"))


def merged(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored sketches with those of new symbols: counts add up, sketches unite. Names that went stay in a sketch; build
    the group anew where that matters."""
    return stored.unionByName(fresh).groupBy("language", "kind").agg(F.sum("symbols").alias("symbols"), F.hll_union_agg("names").alias("names"))


def estimates(stored: DataFrame, *by: str) -> DataFrame:
    """(*by, symbols, names) of stored sketches, united over the columns that aren't named; nothing is read but sketches."""
    return stored.groupBy(*by).agg(F.sum("symbols").alias("symbols"), F.hll_sketch_estimate(F.hll_union_agg("names")).alias("names"))
