"""Incremental maintenance as set algebra over two versions of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status): new, deleted, changed or unchanged, by content hash."""
    a, b = stored.select("path", F.col("content_hash").alias("old")), current.select("path", F.col("content_hash").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def affected_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbol names on one side only, of the files touched."""
    a, b = old.select("name").distinct(), new.select("name").distinct()
    return a.join(b, "name", "left_anti").union(b.join(a, "name", "left_anti"))


def cascade(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``rows`` less those that refer to a deleted id."""
    return rows.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)


def dependents(edges: DataFrame, imports: DataFrame, symbols: DataFrame, touched: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(file_id) of the files that must be resolved again: callers of and importers from touched files, and, given
    ``names``, those with weak edges of such a name; without the touched files themselves."""
    home = symbols.select(F.col("id").alias("sid"), "file_id")
    hit = home.join(touched.select("file_id"), "file_id", "left_semi").select(F.col("sid").alias("dst_symbol_id"))
    source = home.select(F.col("sid").alias("src_symbol_id"), "file_id")
    found = edges.join(hit, "dst_symbol_id", "left_semi").join(source, "src_symbol_id").select("file_id")
    found = found.union(imports.join(touched.select(F.col("file_id").alias("resolved_file_id")), "resolved_file_id", "left_semi").select("file_id"))
    if names is not None:
        weak = edges.where(F.col("resolution").isin("name_only", "unresolved")).join(names.select(F.col("name").alias("dst_name")), "dst_name", "left_semi")
        found = found.union(weak.join(source, "src_symbol_id").select("file_id"))
    return found.distinct().join(touched.select("file_id"), "file_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; old keys that don't return stay."""
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)
