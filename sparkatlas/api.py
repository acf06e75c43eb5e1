"""``CodeIndex``: every query of the index as a DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import indexer
from .operators import graph, retrieval, search, types
from .shared import cut
from .store import Store, locate


class MissingIndex(RuntimeError):
    pass


class CodeIndex:
    """Queries over the index of ``repo``. ``store`` is its folder, below ``home`` unless named."""

    def __init__(self, spark: SparkSession, repo: str, store: str | None = None, home: str | None = None):
        self.spark, self.repo = spark, os.path.realpath(repo)
        self.store = Store(spark, store or locate(repo, home))
        self._lists: retrieval.Index | None = None

    def index(self, full: bool = False, strict: bool = False) -> indexer.IndexResult:
        self._lists = None
        return indexer.index(self.spark, self.repo, self.store, full, strict)

    def require(self) -> CodeIndex:
        if not self.store.exists():
            raise MissingIndex(f"no index for {self.repo}; run: python -m sparkatlas index {self.repo}")
        return self

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.table("edges"), self.table("symbols"), self.table("files")

    def symbols(self, *, path: str | None = None, name: str | None = None, kind: str | None = None, exported: bool = False, no_tests: bool = False, limit: int | None = 200) -> DataFrame:
        found = search.search_symbols(self.table("symbols"), self.table("files"), path=path, name=name, kind=kind, exported=exported, no_tests=no_tests, limit=limit)
        more = self.table("symbols").select("id", "end_line", "signature", "docstring", "is_exported")
        return found.join(more, "id").orderBy("path", "start_line", "id")

    def find(self, name: str) -> DataFrame:
        return search.find_symbol(self.table("symbols"), self.table("files"), name).orderBy("path", "start_line", "id")

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        """(target, id, depth, via_line, via_conf, name, qualified_name, kind, path, is_test) for every symbol so named.

        All of them are walked together.
        """
        edges, symbols, files = self._graph()
        near = graph.callers(edges, self.find(name).select(F.col("id").alias("target"), "id"), depth)
        return graph.described(near, symbols, files).orderBy("target", "depth", "path", "qualified_name", "id")

    def tests_for(self, name: str) -> DataFrame:
        return self.callers(name, 2).where("is_test")

    def calls(self, name: str) -> DataFrame:
        edges, symbols, files = self._graph()
        return graph.calls_from(edges, symbols, files, self.find(name)).orderBy("src_symbol_id", "line", "dst_name")

    def refs(self, name: str, limit: int | None = 200) -> DataFrame:
        return graph.refs_by_name(*self._graph(), name, limit)

    def cochange(self, path: str, limit: int | None = 20, min_lift: float = 2.0) -> DataFrame:
        return search.cochange_for(self.table("cochange"), path, limit, min_lift)

    def hot(self, limit: int = 15) -> DataFrame:
        return search.hot_files(self.table("file_history"), limit)

    def blast_radius(self, name: str) -> DataFrame:
        """(layer, target, depth, label, path, confidence): callers within two calls, co-changing files, covering tests."""
        near = cut(self.callers(name, 2), "near")  # two layers read it
        as_layer = lambda df, layer: df.select(F.lit(layer).alias("layer"), "target", "depth", F.col("qualified_name").alias("label"), "path", F.col("via_conf").alias("confidence"))
        out = as_layer(near, "callers").unionByName(as_layer(near.where("is_test"), "tests"))
        own = self.find(name).select(F.col("id").alias("target"), F.col("path").alias("own"))
        pairs = self.table("cochange").where("lift >= 2.0").selectExpr("inline(array(struct(file_a AS own, file_b AS path, both_count, conf_ab AS confidence, lift), struct(file_b AS own, file_a AS path, both_count, conf_ba AS confidence, lift)))")
        best = Window.partitionBy("target").orderBy(F.desc(F.col("lift") * F.col("both_count")), "path")
        top = own.join(pairs, "own").withColumn("place", F.row_number().over(best)).where("place <= 10")
        label = F.concat(F.col("both_count").cast("string"), F.lit(" commits"))
        return out.unionByName(top.select(F.lit("cochange").alias("layer"), "target", F.lit(None).cast("int").alias("depth"), label.alias("label"), "path", "confidence"))

    def ranked(self, text: str, limit: int = 20) -> DataFrame:
        """(rank, score, id, qualified_name, kind, path, start_line) of the symbols whose names, headers and docs match best.

        The inverted index is made once for this object.
        """
        symbols, files = self.table("symbols"), self.table("files")
        if self._lists is None:
            self._lists = retrieval.build(symbols.select("id", F.concat_ws(" ", "qualified_name", "signature", "docstring").alias("text")))
        found = retrieval.search(self._lists, self.spark.createDataFrame([(0, text)], "query_id long, text string"), limit)
        return graph.described(found.withColumnRenamed("key", "id"), symbols, files).join(symbols.select("id", "start_line"), "id").select("rank", "score", "id", "qualified_name", "kind", "path", "start_line").orderBy("rank")

    def siblings(self, name: str, limit: int = 50) -> DataFrame:
        """(target, id, shared, qualified_name, kind, path): types below the bases and contracts of every type so named."""
        edges = self.table("type_edges").where("base_id IS NOT NULL").select("type_id", "base_id")
        near = types.siblings(edges, self.find(name).select("id"), limit).withColumnRenamed("sibling", "id")
        return graph.described(near, self.table("symbols"), self.table("files")).select("target", "id", "shared", "qualified_name", "kind", "path").orderBy("target", F.desc("shared"), "id")

    def stats(self) -> dict[str, DataFrame]:
        files, symbols = self.table("files"), self.table("symbols")
        return {
            "languages": search.files_by_language(files).orderBy("language"),
            "kinds": search.symbols_by_kind(symbols).orderBy(F.desc("n"), "kind"),
            "skipped": search.skipped_by_reason(files).orderBy("skipped_reason"),
            "totals": search.totals(files, symbols),
            "resolutions": search.resolution_mix(self.table("edges")).orderBy(F.desc("confidence"), "resolution"),
        }

    def directories(self, top: int = 8) -> DataFrame:
        return search.directories(self.table("symbols"), self.table("files"), top)
