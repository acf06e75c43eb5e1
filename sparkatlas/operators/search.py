"""Symbol search and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import directory_bucket, like_ci


def search_symbols(symbols: DataFrame, files: DataFrame, *, path: str | None = None, name: str | None = None, kind: str | None = None, exported: bool = False, no_tests: bool = False, limit: int | None = 200) -> DataFrame:
    """Symbols under every filter given: path suffix and name part (ASCII case folded, wildcards live), kind, flags."""
    f = files.select(F.col("id").alias("file_id"), "path", "is_test")
    if path is not None:
        f = f.where(like_ci(F.col("path"), "%" + path))
    if no_tests:
        f = f.where("NOT is_test")
    s = symbols
    if name is not None:
        s = s.where(like_ci(F.col("name"), f"%{name}%"))
    if kind is not None:
        s = s.where(F.col("kind") == kind)
    if exported:
        s = s.where("is_exported")
    out = s.join(f, "file_id").select("id", "name", "qualified_name", "kind", "start_line", "path").orderBy("path", "start_line", "id")
    return out if limit is None or limit < 0 else out.limit(limit)


def find_symbol(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    found = symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
    return found.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "qualified_name", "kind", "path", "start_line")


def files_by_language(files: DataFrame) -> DataFrame:
    return files.where("skipped_reason IS NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))


def symbols_by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def skipped_by_reason(files: DataFrame) -> DataFrame:
    return files.where("skipped_reason IS NOT NULL").groupBy("skipped_reason").agg(F.count(F.lit(1)).alias("n"))


def totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    a = files.agg(F.count_if(~F.col("parse_ok")).alias("parse_errors"))
    return a.crossJoin(symbols.agg(F.count(F.lit(1)).alias("symbols")))


def directories(symbols: DataFrame, files: DataFrame, top: int = 8) -> DataFrame:
    """The directories with most symbols."""
    placed = symbols.select("file_id").join(files.select(F.col("id").alias("file_id"), directory_bucket(F.col("path")).alias("dir")), "file_id")
    return placed.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(top)


def hot_files(history: DataFrame, top: int = 15) -> DataFrame:
    return history.orderBy(F.desc("change_count"), "path").limit(top)


def cochange_for(pairs: DataFrame, path: str, top: int | None = 20, min_lift: float = 2.0) -> DataFrame:
    """Partners of the files whose path ends so, best lift times support first; where both ends match, file_a counts."""
    a, b = like_ci(F.col("file_a"), "%" + path), like_ci(F.col("file_b"), "%" + path)
    rows = pairs.where((a | b) & (F.col("lift") >= min_lift)).select(
        F.when(a, F.col("file_b")).otherwise(F.col("file_a")).alias("partner"), "both_count", F.when(a, F.col("conf_ab")).otherwise(F.col("conf_ba")).alias("confidence"), "lift"
    )
    out = rows.orderBy(F.desc(F.col("lift") * F.col("both_count")), "partner", "both_count", "confidence")
    return out if top is None or top < 0 else out.limit(top)


def resolution_mix(edges: DataFrame) -> DataFrame:
    """Edges by resolution and their share of all."""
    from pyspark.sql import Window

    n = edges.groupBy("resolution", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()).cast("double"))
