"""Building and maintaining the index: scan, extract, resolve, mine; in full or for what changed."""

from __future__ import annotations

import datetime
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import extract
from .functions.text import dirname
from .operators import history, incremental, resolve, types
from .sources import gitlog, tree
from .store import Store

VERSION = "1"


@dataclass
class IndexResult:
    mode: str
    files: int = 0
    symbols: int = 0
    parse_errors: int = 0
    skipped: dict[str, int] = field(default_factory=dict)
    resolutions: dict[str, int] = field(default_factory=dict)
    reindexed: int = 0
    unchanged: int = 0
    deleted: int = 0
    opened_files: int = 0
    opened_bytes: int = 0
    dependents: int = 0
    commits: int = 0
    bulk_commits: int = 0
    seconds: float = 0.0


def split(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables files, symbols, calls, imports (unresolved) and relations of parsed files."""
    each = lambda c: parsed.select(F.col("id").alias("file_id"), "path", F.posexplode(c).alias("ord", "x"))
    symbols = each("symbols").select(F.xxhash64("path", "x.qualified_name", "x.start_byte").alias("id"), "file_id", "x.*")
    rest = {n: each(n).select("file_id", "ord", "x.*") for n in ("calls", "imports", "relations")}
    return {"files": parsed.drop("symbols", "calls", "imports", "relations", "errors"), "symbols": symbols, **rest}


def bind(imports: DataFrame, files: DataFrame, symbols: DataFrame, module: str | None) -> DataFrame:
    """Imports with the file (Python, TypeScript) or the directory (Go) that they name in the repository."""
    at = files.select(F.col("id").alias("file_id"), "language", dirname(F.col("path")).alias("dir"))
    x = imports.select("file_id", "ord", "module", "symbol", "alias", "line").join(at, "file_id")
    wanted = x.withColumn("candidates", F.when(F.col("language") == "python", resolve.python_candidates(F.col("module"), F.col("dir"))).when(F.col("language") != "go", resolve.typescript_candidates(F.col("module"), F.col("dir"))))
    hits = resolve.probe(wanted.where("candidates IS NOT NULL"), files.where("skipped_reason IS NULL"))
    below = F.when(F.lit(module).isNull() | (F.col("language") != "go"), None).when(F.col("module") == F.lit(module), "").when(F.col("module").startswith(f"{module}/"), F.substring("module", len(module or "") + 2, 1 << 30))
    homes = symbols.select("file_id").distinct().join(at, "file_id").select(F.col("dir").alias("below"), F.lit(True).alias("known")).distinct()
    x = x.withColumn("below", below).join(homes, "below", "left").join(hits, ["file_id", "ord"], "left")
    return x.select("file_id", "ord", "module", "symbol", "alias", "line", "resolved_file_id", F.when((F.col("below") == "") | F.col("known"), F.col("below")).alias("go_dir"))


def link(calls: DataFrame, imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    return resolve.resolve(calls, symbols, files, resolve.bindings(imports))


def _mine(spark: SparkSession, root: str, store: Store, result: IndexResult, prune_stale: bool, max_commits: int | None) -> dict[str, DataFrame]:
    """History tables; rows of pairs and paths that no longer reach the support stay unless ``prune_stale``."""
    commits = gitlog.read_commits(spark, root, max_commits)
    if commits is None:
        return {}
    commits = store.stage(commits)
    tally = commits.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("files") > history.BULK_FILES).alias("bulk")).first()
    result.commits, result.bulk_commits = tally.n, tally.bulk
    fresh = {"cochange": history.cochange(commits), "file_history": history.file_history(commits)}
    keys = {"cochange": ["file_a", "file_b"], "file_history": ["path"]}
    return fresh if prune_stale else {n: incremental.upsert(store.read(n), df, keys[n]) for n, df in fresh.items()}


def _meta(spark: SparkSession, store: Store, **values: str | None) -> DataFrame:
    rows = [(k, v) for k, v in values.items() if v is not None]
    return incremental.upsert(store.read("meta"), spark.createDataFrame(rows, "key string, value string"), ["key"])


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def _tallies(store: Store, result: IndexResult) -> IndexResult:
    files = store.read("files")
    result.files = files.where("skipped_reason IS NULL").count()
    result.parse_errors = files.where("NOT parse_ok").count()
    result.symbols = store.read("symbols").count()
    result.skipped = {r.skipped_reason: r["count"] for r in files.where("skipped_reason IS NOT NULL").groupBy("skipped_reason").count().collect()}
    result.resolutions = {r.resolution: r["count"] for r in store.read("edges").groupBy("resolution").count().collect()}
    return result


def build(spark: SparkSession, root: str, store: Store, max_commits: int | None = gitlog.MAX_COMMITS) -> IndexResult:
    """The whole index from nothing. Every file is read and parsed once; the parsed rows are written once."""
    start, result = time.time(), IndexResult("full")
    parts = split(store.stage(extract(tree.read_tree(spark, root))))
    symbols = store.stage(parts["symbols"])
    imports = store.stage(bind(parts["imports"], parts["files"], symbols, gitlog.go_module(root)))
    mined = _mine(spark, root, store, result, True, max_commits)
    meta = spark.createDataFrame([(k, v) for k, v in {"repo_root": os.path.realpath(root), "indexed_at": _now(), "index_seconds": f"{time.time() - start:.2f}", "commit_sha": gitlog.head(root), "schema_version": VERSION}.items() if v is not None], "key string, value string")
    empty = {n: store.read(n).limit(0) for n in ("cochange", "file_history")}
    relations = store.stage(parts["relations"])
    edges = {"edges": link(parts["calls"], imports, parts["files"], symbols), "type_edges": types.type_edges(relations, symbols, parts["files"])}
    store.publish({"files": parts["files"], "symbols": symbols, "calls": parts["calls"], "imports": imports, "relations": relations, **edges, **empty, **mined, "meta": meta})
    result.reindexed = store.read("files").count()
    result.seconds = time.time() - start
    return _tallies(store, result)


def update(spark: SparkSession, root: str, store: Store, strict: bool = False, prune_stale: bool = False, max_commits: int | None = gitlog.MAX_COMMITS) -> IndexResult:
    """The index after edits: changed and new files are parsed, they and their dependents resolved again.

    Dependents are callers of and importers from touched files and files with weak edges of a name that came or went. An
    edge of another kind whose evidence was a name's uniqueness may go stale; ``strict`` resolves every stored call again,
    parses nothing more, and gives what a full build would. Files whose size and time are the stored ones aren't opened.
    """
    start, result = time.time(), IndexResult("incremental")
    stored, looked = store.read("files"), store.stage(tree.read_tree(spark, root, contents=False))
    known = stored.select("path", F.col("size_bytes").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
    both = looked.join(known, "path", "left")
    same = (F.col("old_size") == F.col("size_bytes")) & (F.col("old_mtime") == F.col("mtime"))
    doubtful = both.where(~F.coalesce(same, F.lit(False)))
    parsed = store.stage(extract(tree.open_files(doubtful, root)))
    result.opened_files, result.opened_bytes = parsed.count(), parsed.where("content_hash <> ''").agg(F.sum("size_bytes")).first()[0] or 0
    hashes = both.where(F.coalesce(same, F.lit(False))).select("path", F.col("old_hash").alias("content_hash")).union(parsed.select("path", "content_hash"))
    status = store.stage(incremental.diff(stored, hashes))
    n = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
    result.unchanged, result.deleted, result.reindexed = n.get("unchanged", 0), n.get("deleted", 0), n.get("changed", 0) + n.get("new", 0)
    head = gitlog.head(root)
    meta = {r.key: r.value for r in store.read("meta").collect()}
    mined = _mine(spark, root, store, result, prune_stale, max_commits) if head != meta.get("commit_sha") else {}
    if not result.reindexed and not result.deleted:
        store.publish({**mined, "meta": _meta(spark, store, commit_sha=head)} if mined else {})
        result.seconds = time.time() - start
        return _tallies(store, result)
    touched = status.where("status <> 'unchanged'").select("path", F.xxhash64("path").alias("file_id"))
    gone = touched.select(F.col("file_id").alias("id"))
    parts = split(parsed.join(status.where("status IN ('changed', 'new')"), "path", "left_semi"))
    old = {t: store.read(t) for t in ("symbols", "calls", "imports", "relations", "edges")}
    seen = split(parsed)["files"]  # files with a new time and old contents too, so that their time counts the next time
    files = store.stage(incremental.cascade(stored, "id", gone).join(seen, "id", "left_anti").unionByName(seen))
    symbols = store.stage(incremental.cascade(old["symbols"], "file_id", gone).unionByName(parts["symbols"]))
    calls = store.stage(incremental.cascade(old["calls"], "file_id", gone).unionByName(parts["calls"]))
    unbound = incremental.cascade(old["imports"], "file_id", gone).select(*parts["imports"].columns).unionByName(parts["imports"])
    relations = store.stage(incremental.cascade(old["relations"], "file_id", gone).unionByName(parts["relations"]))
    names = incremental.affected_names(old["symbols"].join(touched, "file_id", "left_semi"), parts["symbols"])
    more = store.stage(incremental.dependents(old["edges"], old["imports"], old["symbols"], touched, names))
    result.dependents = more.count()
    module = gitlog.go_module(root)
    if strict:
        imports = store.stage(bind(unbound, files, symbols, module))
        edges = link(calls, imports, files, symbols)
    else:
        redo = store.stage(more.union(touched.select("file_id")).distinct())
        kept = old["imports"].join(redo, "file_id", "left_anti")
        imports = store.stage(kept.unionByName(bind(unbound.join(redo, "file_id", "left_semi"), files, symbols, module)))
        homes = old["symbols"].select(F.col("id").alias("src_symbol_id"), "file_id").join(redo, "file_id", "left_semi")
        again = link(calls.join(redo, "file_id", "left_semi"), imports, files, symbols)
        edges = old["edges"].join(homes, "src_symbol_id", "left_anti").select(*again.columns).unionByName(again)
    store.publish({"files": files, "symbols": symbols, "calls": calls, "imports": imports, "relations": relations, "edges": edges, "type_edges": types.type_edges(relations, symbols, files), **mined, "meta": _meta(spark, store, indexed_at=_now(), index_seconds=f"{time.time() - start:.2f}", commit_sha=head)})
    result.seconds = time.time() - start
    return _tallies(store, result)


def index(spark: SparkSession, root: str, store: Store, full: bool = False, strict: bool = False, max_commits: int | None = gitlog.MAX_COMMITS) -> IndexResult:
    """Incremental where an index exists, else (or if asked for) in full."""
    return build(spark, root, store, max_commits) if full or not store.exists() else update(spark, root, store, strict, max_commits=max_commits)
