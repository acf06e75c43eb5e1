"""Call-graph queries: bounded reverse reachability, forward calls, references, covering tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut

def callers(edges: DataFrame, target: DataFrame, depth: int = 1) -> DataFrame:
    """(id, depth, via_line, via_conf): symbols from which ``target(id)`` is reached in at most ``depth`` calls.

    One join a level against the frontier alone; a symbol counts at its least depth, by the smallest (line, confidence)
    there. A recursive target is its own caller. A column ``target`` beside the ids names walks of their own, all of
    them taken in the same joins. Beyond two levels each is written once, so that the next is planned from a table, and the walk ends
    at a level that reaches nothing new.
    """
    keys = [c for c in target.columns if c == "target"] + ["id"]
    calls = edges.where("dst_symbol_id IS NOT NULL").select("src_symbol_id", "dst_symbol_id", "line", "confidence")
    frontier = target.select(*keys).distinct()
    seen = None
    for level in range(1, depth + 1):
        step = calls.join(frontier.withColumnRenamed("id", "dst_symbol_id"), "dst_symbol_id").groupBy(*keys[:-1], F.col("src_symbol_id").alias("id")).agg(F.min(F.struct("line", "confidence")).alias("via"))
        if seen is not None:
            step = step.join(seen.select(*keys), keys, "left_anti")
        step = step.select(*keys, F.lit(level).alias("depth"), F.col("via.line").alias("via_line"), F.col("via.confidence").alias("via_conf"))
        if depth > 2:
            step = cut(step, "callers")
            if seen is not None and step.isEmpty():
                break
        seen = step if seen is None else seen.union(step)
        frontier = step.select(*keys)
    none = target.select(*keys, F.lit(0).alias("depth"), F.lit(0).alias("via_line"), F.lit(0.0).alias("via_conf")).limit(0)
    return none if seen is None else seen


def described(rows: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Adds name, qualified_name, kind and path of the symbol ``id``."""
    named = symbols.select("id", "name", "qualified_name", "kind", "file_id")
    return rows.join(named, "id").join(files.select(F.col("id").alias("file_id"), "path", "is_test"), "file_id").drop("file_id")


def tests_for(edges: DataFrame, symbols: DataFrame, files: DataFrame, target: DataFrame) -> DataFrame:
    """Callers within two calls that live in test files."""
    return described(callers(edges, target, 2), symbols, files).where("is_test").select("id", "depth", "qualified_name", "path")


def calls_from(edges: DataFrame, symbols: DataFrame, files: DataFrame, source: DataFrame) -> DataFrame:
    """One row per call site of the source symbols, resolved or not."""
    own = edges.join(source.select(F.col("id").alias("src_symbol_id")), "src_symbol_id", "left_semi")
    to = symbols.select(F.col("id").alias("dst_symbol_id"), F.col("qualified_name").alias("dst_qualified"), "file_id").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("dst_path")), "file_id").drop("file_id")
    return own.join(to, "dst_symbol_id", "left").select("src_symbol_id", "dst_name", "line", "confidence", "resolution", "dst_qualified", "dst_path")


def refs_by_name(edges: DataFrame, symbols: DataFrame, files: DataFrame, name: str, limit: int | None = 200) -> DataFrame:
    """Every call site whose written callee is ``name``; a negative limit is none."""
    sites = edges.where(F.col("dst_name") == name).select(F.col("src_symbol_id").alias("id"), "line", "confidence", "resolution")
    out = described(sites, symbols, files).select("path", "line", "id", "qualified_name", "confidence", "resolution").orderBy("path", "line", "id", "resolution")
    return out if limit is None or limit < 0 else out.limit(limit)
