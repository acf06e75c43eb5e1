"""Queries over the star schema, mapped to the engine's data model by views that Spark and DuckDB read alike.

``part`` plays files and symbols, ``lineitem`` call sites and edges, ``orders`` imports and commits, ``customer`` authors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import indexer
from ..operators import cube, graph, history, incremental, resolve, search
from ..shared import cut, shared_dir
from ..streaming import baskets

#: Fixed parameters of the queries; ids exist at every scale.
TARGET, SUFFIX, NAME_PART, AS_OF = 44, "_3_.PY", "T_Rod", "2002-01-01"

VIEWS = {
    "v_files": """
        SELECT p_partkey AS id,
            'pkg/' || lower(replace(p_brand, '#', '')) || '/' || replace(lower(p_type), ' ', '_') || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING)
                || CASE CAST(p_size % 4 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' ELSE '.tsx' END AS path,
            CASE CAST(p_size % 4 AS INT) WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'typescript' ELSE 'tsx' END AS language,
            p_size * 10 AS line_count, p_size % 5 = 0 AS is_test, p_size % 13 <> 0 AS parse_ok,
            CASE WHEN p_size % 17 = 0 THEN 'generated' WHEN p_size % 23 = 0 THEN 'too_large' END AS skipped_reason, 'h' || CAST(p_partkey * 31 + p_size AS STRING) AS content_hash
        FROM part""",
    "v_symbols": """
        SELECT p_partkey AS id, p_partkey - p_partkey % 4 AS file_id,
            CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '_') || CAST(p_partkey AS STRING) ELSE replace(p_name, ' ', '_') END AS name,
            replace(p_type, ' ', '_') || '.' || replace(p_name, ' ', '_') AS qualified_name,
            CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind,
            1 + p_partkey % 4 * 10 AS start_line, p_partkey % 4 * 100 AS start_byte,
            CASE WHEN p_partkey % 4 = 0 THEN 400 ELSE p_partkey % 4 * 100 + 80 END AS end_byte, p_size % 2 = 0 AS is_exported
        FROM part""",
    "v_edges": """
        SELECT l_partkey AS src_symbol_id, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE (l_suppkey * 20 + l_linenumber) % n_parts END AS dst_symbol_id,
            'callee_' || CAST((l_suppkey * 20 + l_linenumber) % 97 AS STRING) AS dst_name, l_linenumber AS line,
            CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0.95 WHEN 'AO' THEN 0.95 WHEN 'RF' THEN 0.9 WHEN 'RO' THEN 0.9 WHEN 'NF' THEN 0.5 ELSE 0.0 END AS confidence_,
            CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'receiver' WHEN 'AO' THEN 'package' WHEN 'RF' THEN 'same_file' WHEN 'RO' THEN 'import' WHEN 'NF' THEN 'name_only' ELSE 'unresolved' END AS resolution
        FROM lineitem CROSS JOIN (SELECT count(*) AS n_parts FROM part)""",
    "v_imports": """
        SELECT (o_custkey * 4) % n_parts - (o_custkey * 4) % n_parts % 4 AS file_id, o_orderkey AS ord, o_orderpriority AS alias,
            CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '*' WHEN 1 THEN 'default' ELSE 'sym_' || CAST(o_orderkey % 11 AS STRING) END AS symbol,
            CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 8) % n_parts - (o_orderkey * 8) % n_parts % 4 END AS resolved_file_id
        FROM orders CROSS JOIN (SELECT count(*) AS n_parts FROM part)""",
    "v_touches": """
        SELECT l_orderkey AS seq, l_partkey AS item FROM lineitem GROUP BY l_orderkey, l_partkey""",
}


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


_READS = {"v_files": ("part",), "v_symbols": ("part",), "v_edges": ("lineitem", "part"), "v_imports": ("orders", "part"), "v_touches": ("lineitem",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = _tables(spark, sf_dir, *_READS[name])
    sql = VIEWS[name]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    out = spark.sql(sql, **tables)
    return out.withColumn("confidence", F.col("confidence_").cast("double")).drop("confidence_") if name == "v_edges" else out


#: What a commit made from an order says, in both dialects.
SUBJECT_SQL = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Fixes order' WHEN '2' THEN 'Revert order' WHEN '3' THEN 'prefix added' WHEN '4' THEN 'a bug less' END"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, newest first, with the parts of their lines as files."""
    t = _tables(spark, sf_dir, "orders", "customer")
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    seq = (-F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")).cast("long")) * 100_000_000 - F.col("o_orderkey")
    head = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), seq.alias("seq"), F.col("c_name").alias("author"), when.alias("author_date"), F.expr(SUBJECT_SQL).alias("subject"))
    files = view(spark, sf_dir, "v_touches").groupBy(F.col("seq").alias("key")).agg(F.collect_list(F.concat(F.lit("f"), F.lpad(F.col("item").cast("string"), 8, "0"))).alias("files"))
    # pairs, counts and totals each read the commits: they are made once
    return cut(head.join(files, "key", "left").select("seq", "author", "author_date", "subject", F.coalesce("files", F.array().cast("array<string>")).alias("files")), "commits")


def _target(spark: SparkSession) -> DataFrame:
    return spark.range(TARGET, TARGET + 1)


def _callers(depth: int):
    def run(spark, d):
        rows = graph.callers(view(spark, d, "v_edges"), _target(spark), depth)
        return graph.described(rows, view(spark, d, "v_symbols"), view(spark, d, "v_files")).select("id", "depth", "via_line", "via_conf", "qualified_name", "path")

    return run


def _tests_for(spark, d):
    return graph.tests_for(view(spark, d, "v_edges"), view(spark, d, "v_symbols"), view(spark, d, "v_files"), _target(spark))


def _calls_from(spark, d):
    return graph.calls_from(view(spark, d, "v_edges"), view(spark, d, "v_symbols"), view(spark, d, "v_files"), _target(spark)).drop("src_symbol_id")


def _refs(spark, d):
    return graph.refs_by_name(view(spark, d, "v_edges"), view(spark, d, "v_symbols"), view(spark, d, "v_files"), "callee_5", None)


def _search(**options):
    return lambda spark, d: search.search_symbols(view(spark, d, "v_symbols"), view(spark, d, "v_files"), limit=None, **options)


def _next_files(spark, d):
    return view(spark, d, "v_files").where("id % 11 <> 3").withColumn("content_hash", F.when(F.col("id") % 9 == 2, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))).withColumn(
        "path", F.when(F.col("id") % 13 == 5, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    )


def _touched(spark, d):
    return view(spark, d, "v_symbols").where("file_id % 24 = 0")


def _renamed(spark, d):
    return _touched(spark, d).withColumn("name", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("_v2"))).otherwise(F.col("name")))


def _dependents(spark, d):
    symbols = view(spark, d, "v_symbols")
    return incremental.dependents(view(spark, d, "v_edges"), view(spark, d, "v_imports"), symbols, symbols.where("file_id % 40 = 0").select("file_id").distinct())


def _cascade(spark, d):
    gone = view(spark, d, "v_symbols").where("id % 5 = 0")
    kept = incremental.cascade(view(spark, d, "v_edges"), "src_symbol_id", gone)
    return search.resolution_mix(kept).select("resolution", "n")


def _upsert(spark, d):
    pairs = history.cochange(commits(spark, d), 2).select("file_a", "file_b", "both_count")
    fresh = pairs.where("both_count > 2").withColumn("both_count", F.col("both_count") * 10)
    return incremental.upsert(pairs, fresh, ["file_a", "file_b"])


def _calls(spark, d):
    t = _tables(spark, d, "lineitem", "part")
    n = t["part"].agg(F.count(F.lit(1)).alias("n_parts"))
    base = t["lineitem"].groupBy((F.col("l_partkey") - F.col("l_partkey") % 4).alias("file_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    base = base.agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("rf"), F.min("l_linenumber").alias("line")).crossJoin(F.broadcast(n))
    names = view(spark, d, "v_symbols").select(F.col("id").alias("cid"), F.col("name").alias("callee"), F.split_part("qualified_name", F.lit("."), F.lit(1)).alias("type"))
    x = base.withColumn("cid", F.when(F.col("ord") % 4 == 0, F.col("file_id") + F.col("s") % 4).otherwise((F.col("s") * 20 + F.col("line")) % F.col("n_parts"))).join(names, "cid")
    return x.select(
        "file_id", "ord", "callee", F.when(F.col("rf") == "R", F.lit("self")).when(F.col("rf") == "A", F.concat(F.lit("m"), (F.col("s") % 5).cast("string"))).alias("receiver"),
        F.when(F.col("rf") == "R", F.col("type")).alias("receiver_type_hint"), "line", ((F.col("ord") * 7) % 430).alias("start_byte"),
    )


def _ladder_imports(spark, d):
    """Aliases that calls use: half bind a receiver, half a name."""
    s = view(spark, d, "v_symbols").select("file_id", "id", "name").join(view(spark, d, "v_files").select(F.col("id").alias("rid"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir")), F.col("id") == F.col("rid"))
    return s.select(
        F.pmod(F.col("file_id") + 8, F.lit(200)).alias("file_id"), F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("m"), (F.col("id") % 5).cast("string"))).otherwise(F.col("name")).alias("alias"),
        F.when(F.col("id") % 9 == 0, F.lit("*")).otherwise(F.col("name")).alias("symbol"), F.when(F.col("id") % 4 != 2, F.col("id") - F.col("id") % 4).alias("resolved_file_id"), F.when(F.col("id") % 4 == 2, F.col("dir")).alias("go_dir"),
    )


def _edges_resolved(spark, d):
    files, symbols = view(spark, d, "v_files"), view(spark, d, "v_symbols")
    return resolve.resolve(_calls(spark, d), symbols, files, resolve.bindings(_ladder_imports(spark, d)))


def _enclosing(spark, d):
    return resolve.enclosing(_calls(spark, d).select("file_id", "ord", "start_byte"), view(spark, d, "v_symbols"))


def _probe(spark, d):
    part = _tables(spark, d, "part")["part"]
    files = view(spark, d, "v_files").select("path", "id")
    stem = F.concat(F.lit("pkg/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    wanted = part.select(F.col("p_partkey").alias("file_id"), F.lit(0).alias("ord"), F.array(*[F.concat(stem, F.lit(x)) for x in (".py", ".ts", ".tsx")]).alias("candidates"))
    return resolve.probe(wanted, files)


def _blast(spark, d):
    """Callers within two calls, covering tests and files that change together, in one table."""
    e, s, f = view(spark, d, "v_edges"), view(spark, d, "v_symbols"), view(spark, d, "v_files")
    near = graph.described(graph.callers(e, _target(spark), 2), s, f).select(F.lit("callers").alias("layer"), "id", "depth", "path")
    pairs = history.cochange(commits(spark, d), 2).where("lift >= 2.0").selectExpr("inline(array(struct(file_a AS own, file_b AS path), struct(file_b AS own, file_a AS path)))")
    together = pairs.where(F.col("own") == f"f{TARGET:08d}").select(F.lit("cochange").alias("layer"), F.lit(TARGET).cast("long").alias("id"), F.lit(0).alias("depth"), "path")
    return near.unionByName(graph.tests_for(e, s, f, _target(spark)).select(F.lit("tests").alias("layer"), "id", "depth", "path")).unionByName(together)


def _probe_order(spark, d):
    """Candidates that compete: of the modules made from a part, two or three of four paths exist."""
    part = _tables(spark, d, "part")["part"].select(F.col("p_partkey").alias("id"))
    paths = F.array(*[F.concat(F.lit(a), F.col("id").cast("string"), F.lit(z)) for a, z in (("m", ".py"), ("m", "/__init__.py"), ("src/m", ".py"), ("src/m", "/__init__.py"))])
    files = part.select(F.posexplode(paths).alias("at", "path"), "id").where("(id + at) % 3 <> 0").select("path", (F.col("id") * 10 + F.col("at")).alias("id"))
    wanted = part.select(F.col("id").alias("file_id"), F.lit(0).alias("ord"), resolve.python_candidates(F.concat(F.lit("m"), F.col("id").cast("string")), F.lit("")).alias("candidates"))
    return resolve.probe(wanted, files)


def _probe_typescript(spark, d):
    """Relative modules made from parts, some with a script's suffix: one of six paths exists, or none."""
    part = _tables(spark, d, "part")["part"].select(F.col("p_partkey").alias("id"))
    key = F.col("id").cast("string")
    tails = F.array(*[F.concat(F.lit("web/m"), key, F.lit(t)) for t in (".ts", ".tsx", ".mts", ".cts", "/index.ts", "/index.tsx")])
    files = part.select(F.posexplode(tails).alias("at", "path"), "id").where("(id + at) % 7 = 1").select("path", (F.col("id") * 10 + F.col("at")).alias("id"))
    module = F.concat(F.when(F.col("id") % 2 == 0, F.lit("../m")).otherwise(F.lit("./../m")), key, F.when(F.col("id") % 5 == 0, F.lit(".js")).when(F.col("id") % 5 == 1, F.lit(".jsx")).otherwise(F.lit("")))
    wanted = part.select(F.col("id").alias("file_id"), F.lit(0).alias("ord"), resolve.typescript_candidates(module, F.lit("web/app")).alias("candidates"))
    return resolve.probe(wanted, files)


def _go_directories(spark, d):
    """Imports of Go files: a directory of another part, the module itself, a package elsewhere and a directory without symbols."""
    files, symbols = view(spark, d, "v_files"), view(spark, d, "v_symbols")
    n = files.agg(F.count(F.lit(1)).alias("n"))
    other = files.select(F.col("id").alias("oid"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    own = files.where("language = 'go'").select(F.col("id").alias("file_id")).crossJoin(F.broadcast(n)).withColumn("oid", F.col("file_id") * 7 % F.col("n")).join(other, "oid")
    modules = F.array(F.concat(F.lit("ex.org/m/"), "dir"), F.lit("ex.org/m"), F.lit("fmt"), F.lit("ex.org/m/none"))
    imports = own.select("file_id", F.posexplode(modules).alias("ord", "module"))
    imports = imports.select("file_id", "ord", "module", F.lit(None).cast("string").alias("symbol"), F.element_at(F.split("module", "/"), -1).alias("alias"), F.lit(1).alias("line"))
    return indexer.bind(imports, files, symbols, "ex.org/m").select("file_id", "ord", "module", "go_dir")


def _dependents_by_name(spark, d):
    """Files to resolve again after an edit of one file by which one name came or went."""
    names = spark.range(1).select(F.lit("callee_5").alias("name"))
    return incremental.dependents(view(spark, d, "v_edges"), view(spark, d, "v_imports"), view(spark, d, "v_symbols"), _target(spark).select(F.col("id").alias("file_id")), names)


def _customer_commits(spark, d):
    """A customer's orders as one commit, so that many touch more than the bulk limit; a part on several lines is listed twice."""
    t = _tables(spark, d, "orders", "lineitem")
    files = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("seq")).agg(F.collect_list(F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"))).alias("files"))
    return cut(files.select("seq", F.lit("a").alias("author"), F.lit("1970-01-01").alias("author_date"), "files"), "commits")


def _cochange_bulk(spark, d):
    return history.cochange(_customer_commits(spark, d), 3).select("file_a", "file_b", "both_count", "a_count", "b_count")


def _cochange_for(min_lift: float):
    return lambda spark, d: search.cochange_for(history.cochange(commits(spark, d), 2), "7", 20, min_lift)


def _owners(spark, d):
    """Weights of two halves of the history, added up."""
    c = commits(spark, d)
    return history.owners(history.added(history.decayed(c.where("seq % 2 = 0")), history.decayed(c.where("seq % 2 <> 0"))))


def _stream(spark, d):
    """Pairs of kinds of events that actors have on one day, from baskets that a stream keeps up."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    path = f"{d}/events.parquet"
    item = F.concat("event_type", F.lit(":"), (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10).cast("string"))
    stream = baskets.touches(spark, path, spark.read.parquet(path).schema, F.col("user_id"), item, F.col("ts"))
    baskets.keep_up(stream, folder).awaitTermination()
    found = baskets.current(spark, folder).select(F.col("actor").alias("seq"), F.lit("a").alias("author"), F.lit("1970-01-01").alias("author_date"), "files")
    return history.cochange(found, 3).select("file_a", "file_b", "both_count", "a_count", "b_count")


QUERIES = {
    "cochange_pairs": lambda spark, d: history.cochange(commits(spark, d)),
    "cochange_for": _cochange_for(2.0),
    "cochange_min_lift": _cochange_for(20.0),
    "file_history": lambda spark, d: history.file_history(commits(spark, d)),
    "hot_files": lambda spark, d: search.hot_files(history.file_history(commits(spark, d))),
    "stats_files_by_language": lambda spark, d: search.files_by_language(view(spark, d, "v_files")),
    "stats_symbols_by_kind": lambda spark, d: search.symbols_by_kind(view(spark, d, "v_symbols")),
    "stats_skipped": lambda spark, d: search.skipped_by_reason(view(spark, d, "v_files")),
    "stats_totals": lambda spark, d: search.totals(view(spark, d, "v_files"), view(spark, d, "v_symbols")),
    "resolution_mix": lambda spark, d: search.resolution_mix(view(spark, d, "v_edges")),
    "dir_histogram": lambda spark, d: search.directories(view(spark, d, "v_symbols"), view(spark, d, "v_files")),
    "search_symbols": _search(name=NAME_PART, kind="method", exported=True, no_tests=True),
    "search_suffix_ci": _search(path=SUFFIX),
    "find_symbol_exact": lambda spark, d: search.find_symbol(view(spark, d, "v_symbols").withColumn("name", F.split_part("name", F.lit("_"), F.lit(1))), view(spark, d, "v_files"), "hot"),
    "calls_from": _calls_from,
    "refs_by_name": _refs,
    "refs_limited": lambda spark, d: graph.refs_by_name(view(spark, d, "v_edges"), view(spark, d, "v_symbols"), view(spark, d, "v_files"), "callee_5"),
    "search_limited": lambda spark, d: search.search_symbols(view(spark, d, "v_symbols"), view(spark, d, "v_files")),
    "probe_order": _probe_order,
    "probe_typescript": _probe_typescript,
    "go_directories": _go_directories,
    "dependents_by_name": _dependents_by_name,
    "cochange_bulk": _cochange_bulk,
    "callers_depth1": _callers(1),
    "callers_depth2": _callers(2),
    "callers_depth3": _callers(3),
    "tests_for_symbol": _tests_for,
    "blast_radius": _blast,
    "enclosing_symbol": _enclosing,
    "import_probe": _probe,
    "last_alias_wins": lambda spark, d: resolve.bindings(view(spark, d, "v_imports").withColumn("go_dir", F.lit(None).cast("string"))).drop("go_dir"),
    "ladder": _edges_resolved,
    "ladder_breakdown": lambda spark, d: search.resolution_mix(_edges_resolved(spark, d)).select("resolution", "confidence", "n"),
    "incremental_diff": lambda spark, d: incremental.diff(view(spark, d, "v_files"), _next_files(spark, d)),
    "affected_names": lambda spark, d: incremental.affected_names(_touched(spark, d), _renamed(spark, d)),
    "dependents": _dependents,
    "cascade_delete": _cascade,
    "upsert_cochange": _upsert,
    "file_owners": _owners,
    "file_signals": lambda spark, d: history.signals(commits(spark, d), AS_OF),
    "symbol_cube": lambda spark, d: cube.cube(view(spark, d, "v_symbols"), view(spark, d, "v_files")),
    "stream_baskets": _stream,
}

_V = {k: f"{k} AS ({v})" for k, v in VIEWS.items()}
_V["v_edges"] = "v_edges0 AS (" + VIEWS["v_edges"] + "), v_edges AS (SELECT src_symbol_id, dst_symbol_id, dst_name, line, CAST(confidence_ AS DOUBLE) AS confidence, resolution FROM v_edges0)"
_V["v_commits"] = """v_commits AS (
    SELECT o_orderkey AS key, -CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 100000000 - o_orderkey AS seq, c_name AS author, strftime(o_orderdate, '%Y-%m-%d') AS author_date,
        coalesce(f.n, 0) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT seq AS key, count(*) AS n FROM v_touches GROUP BY 1) f ON f.key = o_orderkey),
    v_rows AS (SELECT c.*, 'f' || lpad(CAST(t.item AS STRING), 8, '0') AS path FROM v_commits c JOIN v_touches t ON t.seq = c.key WHERE c.n <= 50)"""


def _with(*names: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(_V[n] for n in names)}{', ' + more if more else ''} "


def _pairs_sql(support: int) -> str:
    return f"""one AS (SELECT path, count(*) AS n FROM v_rows GROUP BY path), total AS (SELECT count(*) AS total FROM v_commits WHERE n <= 50),
        both_ AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS both_count FROM v_rows a JOIN v_rows b ON a.seq = b.seq AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= {support}),
        pairs AS (SELECT file_a, file_b, both_count, x.n AS a_count, y.n AS b_count, CAST(both_count AS DOUBLE) / total AS support, CAST(both_count AS DOUBLE) / x.n AS conf_ab,
            CAST(both_count AS DOUBLE) / y.n AS conf_ba, CAST(both_count AS DOUBLE) * total / (CAST(x.n AS DOUBLE) * y.n) AS lift
            FROM both_ JOIN one x ON x.path = file_a JOIN one y ON y.path = file_b CROSS JOIN total)"""


_HISTORY = """ranked AS (SELECT path, author, count(*) AS n, min(seq) AS seq, arg_min(author_date, seq) AS day FROM v_rows GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, seq, author) AS r FROM ranked),
    hist AS (SELECT path, CAST(sum(n) AS BIGINT) AS change_count, arg_min(day, seq) AS last_changed,
        string_agg(author || ' (' || CAST(n AS STRING) || ')', '; ' ORDER BY r) FILTER (WHERE r <= 3) AS top_authors FROM top GROUP BY path)"""


def _callers_sql(depth: int) -> str:
    return _with("v_edges", "v_symbols", "v_files", recursive=True, more=f"""up AS (SELECT CAST({TARGET} AS BIGINT) AS id, 0 AS depth, 0 AS line, CAST(0 AS DOUBLE) AS conf
        UNION SELECT e.src_symbol_id, up.depth + 1, e.line, e.confidence FROM v_edges e JOIN up ON e.dst_symbol_id = up.id WHERE up.depth < {depth}),
        found AS (SELECT id, min(depth) AS depth, min({{'d': depth, 'l': line, 'c': conf}}) AS m FROM up WHERE depth > 0 GROUP BY id)""")  # fmt: skip


_DESCRIBED = "FROM found u JOIN v_symbols s ON s.id = u.id JOIN v_files f ON f.id = s.file_id"


def _like(c: str, pattern: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '{pattern.lower()}'"


def _cochange_for_sql(min_lift: float) -> str:
    a, b = _like("file_a", "%7"), _like("file_b", "%7")
    return _with("v_touches", "v_commits", more=_pairs_sql(2)) + f"""SELECT CASE WHEN {a} THEN file_b ELSE file_a END AS partner, both_count, CASE WHEN {a} THEN conf_ab ELSE conf_ba END AS confidence, lift
        FROM pairs WHERE ({a} OR {b}) AND lift >= {min_lift} ORDER BY lift * both_count DESC, partner, both_count, confidence LIMIT 20"""


_SEARCH = "SELECT s.id, s.name, s.qualified_name, s.kind, s.start_line, f.path FROM v_symbols s JOIN v_files f ON f.id = s.file_id WHERE "
_CALLS = """base AS (SELECT l_partkey - l_partkey % 4 AS file_id, l_orderkey * 100 + l_linenumber AS ord, min(l_suppkey) AS s, min(l_returnflag) AS rf, min(l_linenumber) AS line
        FROM lineitem GROUP BY 1, 2),
    calls AS (SELECT b.file_id, b.ord, v.name AS callee, CASE WHEN rf = 'R' THEN 'self' WHEN rf = 'A' THEN 'm' || CAST(s % 5 AS STRING) END AS receiver,
        CASE WHEN rf = 'R' THEN split_part(v.qualified_name, '.', 1) END AS hint, line, ord * 7 % 430 AS start_byte
        FROM base b CROSS JOIN (SELECT count(*) AS n FROM part) JOIN v_symbols v ON v.id = CASE WHEN ord % 4 = 0 THEN b.file_id + s % 4 ELSE (s * 20 + line) % n END),
    enc AS (SELECT c.file_id, c.ord, c.start_byte, v.id AS src_symbol_id FROM calls c JOIN v_symbols v ON v.file_id = c.file_id AND v.start_byte <= c.start_byte AND c.start_byte < v.end_byte
        QUALIFY row_number() OVER (PARTITION BY c.file_id, c.ord ORDER BY v.start_byte DESC, v.end_byte, v.id) = 1)"""
_LADDER = _CALLS + """,
    fl AS (SELECT id, language, regexp_replace(path, '/?[^/]*$', '') AS dir FROM v_files),
    sy AS (SELECT v.*, fl.dir FROM v_symbols v JOIN fl ON fl.id = v.file_id),
    imp AS (SELECT (v.file_id + 8) % 200 AS file_id, v.id AS ord, CASE WHEN v.id % 2 = 0 THEN 'm' || CAST(v.id % 5 AS STRING) ELSE v.name END AS alias, CASE WHEN v.id % 9 = 0 THEN '*' ELSE v.name END AS symbol,
        CASE WHEN v.id % 4 <> 2 THEN v.id - v.id % 4 END AS rfile, CASE WHEN v.id % 4 = 2 THEN fl.dir END AS gdir FROM v_symbols v JOIN fl ON fl.id = v.id),
    bind AS (SELECT * FROM imp QUALIFY row_number() OVER (PARTITION BY file_id, alias ORDER BY ord DESC) = 1),
    f3 AS (SELECT file_id, name, arg_min(id, start_byte) AS id FROM sy GROUP BY 1, 2),
    x AS (SELECT e.src_symbol_id, c.callee, c.line, c.receiver, fl.language,
        (SELECT count(*) FROM sy WHERE sy.qualified_name = c.hint || '.' || c.callee) AS qn, (SELECT min(id) FROM sy WHERE sy.qualified_name = c.hint || '.' || c.callee) AS qid,
        (SELECT count(*) FROM sy WHERE sy.qualified_name = c.hint || '.' || c.callee AND sy.dir = fl.dir) AS qdn, (SELECT min(id) FROM sy WHERE sy.qualified_name = c.hint || '.' || c.callee AND sy.dir = fl.dir) AS qdid,
        (SELECT count(*) FROM sy WHERE sy.dir = fl.dir AND sy.name = c.callee) AS dn, (SELECT min(id) FROM sy WHERE sy.dir = fl.dir AND sy.name = c.callee) AS did,
        own.id AS fid, bi.id AS iid, bb.symbol AS bsym,
        (SELECT count(*) FROM sy WHERE sy.dir = br.gdir AND sy.name = c.callee) AS gn, (SELECT min(id) FROM sy WHERE sy.dir = br.gdir AND sy.name = c.callee) AS gid, hh.id AS hid,
        (SELECT count(*) FROM sy WHERE sy.name = c.callee) AS un, (SELECT min(id) FROM sy WHERE sy.name = c.callee) AS uid,
        (SELECT count(*) FROM sy WHERE sy.name = c.callee AND kind = 'method') AS mn, (SELECT min(id) FROM sy WHERE sy.name = c.callee AND kind = 'method') AS mid
        FROM calls c JOIN enc e ON e.file_id = c.file_id AND e.ord = c.ord JOIN fl ON fl.id = c.file_id
        LEFT JOIN f3 own ON own.file_id = c.file_id AND own.name = c.callee
        LEFT JOIN bind bb ON bb.file_id = c.file_id AND bb.alias = c.callee LEFT JOIN f3 bi ON bi.file_id = bb.rfile AND bi.name = bb.symbol
        LEFT JOIN bind br ON br.file_id = c.file_id AND br.alias = c.receiver LEFT JOIN f3 hh ON hh.file_id = br.rfile AND hh.name = c.callee),
    r AS (SELECT *, CASE WHEN qn = 1 THEN 1 WHEN qn > 1 AND qdn = 1 THEN 2 WHEN qn > 1 THEN 0 WHEN receiver IS NULL AND language = 'go' AND dn = 1 THEN 3 WHEN receiver IS NULL AND language = 'go' AND dn > 1 THEN 0
        WHEN receiver IS NULL AND language <> 'go' AND fid IS NOT NULL THEN 4 WHEN receiver IS NULL AND language <> 'go' AND coalesce(bsym, '*') NOT IN ('*', 'default') AND iid IS NOT NULL THEN 5
        WHEN receiver IS NOT NULL AND gn = 1 THEN 6 WHEN receiver IS NOT NULL AND hid IS NOT NULL THEN 7 WHEN receiver IS NULL AND un = 1 THEN 8 WHEN receiver IS NOT NULL AND mn = 1 THEN 9 ELSE 0 END AS k FROM x),
    edge AS (SELECT src_symbol_id, CASE k WHEN 1 THEN qid WHEN 2 THEN qdid WHEN 3 THEN did WHEN 4 THEN fid WHEN 5 THEN iid WHEN 6 THEN gid WHEN 7 THEN hid WHEN 8 THEN uid WHEN 9 THEN mid END AS dst_symbol_id, callee AS dst_name, line,
        CAST(CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 0.95 WHEN 3 THEN 0.95 WHEN 8 THEN 0.5 WHEN 9 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence,
        CASE k WHEN 0 THEN 'unresolved' WHEN 1 THEN 'receiver' WHEN 2 THEN 'receiver' WHEN 3 THEN 'package' WHEN 4 THEN 'same_file' WHEN 8 THEN 'name_only' WHEN 9 THEN 'name_only' ELSE 'import' END AS resolution FROM r)"""

ORACLE = {
    "cochange_pairs": _with("v_touches", "v_commits", more=_pairs_sql(3)) + "SELECT * FROM pairs",
    "cochange_for": _cochange_for_sql(2.0),
    "cochange_min_lift": _cochange_for_sql(20.0),
    "file_history": _with("v_touches", "v_commits", more=_HISTORY) + "SELECT * FROM hist",
    "hot_files": _with("v_touches", "v_commits", more=_HISTORY) + "SELECT * FROM hist ORDER BY change_count DESC, path LIMIT 15",
    "stats_files_by_language": _with("v_files") + "SELECT language, count(*) AS files, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS lines FROM v_files WHERE skipped_reason IS NULL GROUP BY language",
    "stats_symbols_by_kind": _with("v_symbols") + "SELECT kind, count(*) AS n FROM v_symbols GROUP BY kind",
    "stats_skipped": _with("v_files") + "SELECT skipped_reason, count(*) AS n FROM v_files WHERE skipped_reason IS NOT NULL GROUP BY skipped_reason",
    "stats_totals": _with("v_files", "v_symbols") + "SELECT (SELECT count(*) FROM v_files WHERE NOT parse_ok) AS parse_errors, (SELECT count(*) FROM v_symbols) AS symbols",
    "resolution_mix": _with("v_edges") + "SELECT resolution, confidence, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM v_edges GROUP BY resolution, confidence",
    "dir_histogram": _with("v_symbols", "v_files") + """SELECT CASE WHEN NOT contains(path, '/') THEN '(root)' WHEN len(string_split(path, '/')) = 2 THEN split_part(path, '/', 1)
        ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS dir, count(*) AS n FROM v_symbols s JOIN v_files f ON f.id = s.file_id GROUP BY 1 ORDER BY n DESC, dir LIMIT 8""",
    "search_symbols": _with("v_symbols", "v_files") + _SEARCH + f"{_like('s.name', '%' + NAME_PART + '%')} AND s.kind = 'method' AND s.is_exported AND NOT f.is_test",
    "search_suffix_ci": _with("v_symbols", "v_files") + _SEARCH + _like("f.path", "%" + SUFFIX),
    "find_symbol_exact": _with("v_symbols", "v_files") + "SELECT s.id, split_part(s.name, '_', 1) AS name, s.qualified_name, s.kind, f.path, s.start_line FROM v_symbols s JOIN v_files f ON f.id = s.file_id WHERE split_part(s.name, '_', 1) = 'hot' OR s.qualified_name = 'hot'",
    "calls_from": _with("v_edges", "v_symbols", "v_files") + f"""SELECT e.dst_name, e.line, e.confidence, e.resolution, s.qualified_name AS dst_qualified, f.path AS dst_path
        FROM v_edges e LEFT JOIN v_symbols s ON s.id = e.dst_symbol_id LEFT JOIN v_files f ON f.id = s.file_id WHERE e.src_symbol_id = {TARGET}""",
    "refs_by_name": _with("v_edges", "v_symbols", "v_files") + "SELECT f.path, e.line, s.id, s.qualified_name, e.confidence, e.resolution FROM v_edges e JOIN v_symbols s ON s.id = e.src_symbol_id JOIN v_files f ON f.id = s.file_id WHERE e.dst_name = 'callee_5'",
    "refs_limited": _with("v_edges", "v_symbols", "v_files") + "SELECT f.path, e.line, s.id, s.qualified_name, e.confidence, e.resolution FROM v_edges e JOIN v_symbols s ON s.id = e.src_symbol_id JOIN v_files f ON f.id = s.file_id WHERE e.dst_name = 'callee_5' ORDER BY f.path, e.line, s.id, e.resolution LIMIT 200",
    "search_limited": _with("v_symbols", "v_files") + _SEARCH + "true ORDER BY f.path, s.start_line, s.id LIMIT 200",
    "probe_order": """
        WITH p AS (SELECT p_partkey AS id FROM part), f AS (SELECT id, unnest([0, 1, 2, 3]) AS k FROM p)
        SELECT id AS file_id, 0 AS ord, min(id * 10 + k) AS resolved_file_id FROM f WHERE (id + k) % 3 <> 0 GROUP BY id""",
    "probe_typescript": "SELECT p_partkey AS file_id, 0 AS ord, p_partkey * 10 + (8 - p_partkey % 7) % 7 AS resolved_file_id FROM part WHERE (8 - p_partkey % 7) % 7 < 6",
    "go_directories": _with("v_files", "v_symbols", more="""f AS (SELECT id, language, regexp_replace(path, '/?[^/]*$', '') AS dir FROM v_files), c AS (SELECT count(*) AS n FROM f), homes AS (SELECT DISTINCT f.dir FROM v_symbols s JOIN f ON f.id = s.file_id),
        o AS (SELECT g.id AS file_id, x.dir FROM f g CROSS JOIN c JOIN f x ON x.id = g.id * 7 % c.n WHERE g.language = 'go')""")
    + """SELECT file_id, 0 AS ord, 'ex.org/m/' || o.dir AS module, homes.dir AS go_dir FROM o LEFT JOIN homes ON homes.dir = o.dir UNION ALL SELECT file_id, 1, 'ex.org/m', '' FROM o
        UNION ALL SELECT file_id, 2, 'fmt', NULL FROM o UNION ALL SELECT file_id, 3, 'ex.org/m/none', NULL FROM o""",
    "dependents_by_name": _with("v_edges", "v_symbols", "v_imports", more="e AS (SELECT s.file_id, x.file_id AS dst_file, e.resolution, e.dst_name FROM v_edges e JOIN v_symbols s ON s.id = e.src_symbol_id LEFT JOIN v_symbols x ON x.id = e.dst_symbol_id)")
    + f"""SELECT file_id FROM (SELECT file_id FROM e WHERE dst_file = {TARGET} UNION SELECT file_id FROM v_imports WHERE resolved_file_id = {TARGET}
        UNION SELECT file_id FROM e WHERE resolution IN ('name_only', 'unresolved') AND dst_name = 'callee_5') WHERE file_id <> {TARGET}""",
    "cochange_bulk": """
        WITH x AS (SELECT o_custkey AS seq, 'f' || (l_partkey % 50) AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        u AS (SELECT * FROM x WHERE seq IN (SELECT seq FROM x GROUP BY seq HAVING count(*) <= 50)),
        n AS (SELECT path, count(*) AS n FROM u GROUP BY path), y AS (SELECT DISTINCT seq, path FROM u),
        b AS (SELECT p.path AS file_a, q.path AS file_b, count(*) AS both_count FROM y p JOIN y q ON p.seq = q.seq AND p.path < q.path GROUP BY ALL HAVING count(*) >= 3)
        SELECT b.*, na.n AS a_count, nb.n AS b_count FROM b JOIN n na ON na.path = file_a JOIN n nb ON nb.path = file_b""",
    **{f"callers_depth{n}": _callers_sql(n) + f"SELECT u.id, u.depth, u.m.l AS via_line, u.m.c AS via_conf, s.qualified_name, f.path {_DESCRIBED}" for n in (1, 2, 3)},
    "tests_for_symbol": _callers_sql(2) + f"SELECT u.id, u.depth, s.qualified_name, f.path {_DESCRIBED} WHERE f.is_test",
    "blast_radius": _callers_sql(2) + f"SELECT 'callers' AS layer, u.id, u.depth, f.path {_DESCRIBED} UNION ALL SELECT 'tests', u.id, u.depth, f.path {_DESCRIBED} WHERE f.is_test"
    + f" UNION ALL SELECT * FROM ({_with('v_touches', 'v_commits', more=_pairs_sql(2))} SELECT 'cochange' AS layer, CAST({TARGET} AS BIGINT) AS id, 0 AS depth, CASE WHEN file_a = 'f{TARGET:08d}' THEN file_b ELSE file_a END AS path"
    + f" FROM pairs WHERE lift >= 2.0 AND 'f{TARGET:08d}' IN (file_a, file_b))",
    "enclosing_symbol": _with("v_symbols", more=_CALLS) + "SELECT * FROM enc",
    "import_probe": _with("v_files") + "SELECT id AS file_id, 0 AS ord, id AS resolved_file_id FROM v_files WHERE language <> 'go'",
    "last_alias_wins": _with("v_imports") + "SELECT file_id, alias, symbol, resolved_file_id FROM v_imports QUALIFY row_number() OVER (PARTITION BY file_id, alias ORDER BY ord DESC) = 1",
    "ladder": _with("v_files", "v_symbols", more=_LADDER) + "SELECT * FROM edge",
    "ladder_breakdown": _with("v_files", "v_symbols", more=_LADDER) + "SELECT resolution, confidence, count(*) AS n FROM edge GROUP BY resolution, confidence",
    "incremental_diff": _with("v_files", more="nxt AS (SELECT CASE WHEN id % 13 = 5 THEN path || '.new' ELSE path END AS path, CASE WHEN id % 9 = 2 THEN content_hash || 'x' ELSE content_hash END AS h FROM v_files WHERE id % 11 <> 3)")
    + "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.content_hash <> b.h THEN 'changed' ELSE 'unchanged' END AS status FROM v_files a FULL JOIN nxt b ON a.path = b.path",
    "affected_names": _with("v_symbols", more="o AS (SELECT DISTINCT name FROM v_symbols WHERE file_id % 24 = 0), n AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN name || '_v2' ELSE name END AS name FROM v_symbols WHERE file_id % 24 = 0)")
    + "(SELECT name FROM o EXCEPT SELECT name FROM n) UNION ALL (SELECT name FROM n EXCEPT SELECT name FROM o)",
    "dependents": _with("v_edges", "v_imports", "v_symbols") + """SELECT file_id FROM (SELECT s.file_id FROM v_edges e JOIN v_symbols t ON t.id = e.dst_symbol_id AND t.file_id % 40 = 0 JOIN v_symbols s ON s.id = e.src_symbol_id
        UNION SELECT file_id FROM v_imports WHERE resolved_file_id % 40 = 0 AND resolved_file_id IN (SELECT file_id FROM v_symbols)) WHERE NOT (file_id % 40 = 0 AND file_id IN (SELECT file_id FROM v_symbols))""",
    "cascade_delete": _with("v_edges") + "SELECT resolution, count(*) AS n FROM v_edges WHERE src_symbol_id % 5 <> 0 GROUP BY resolution",
    "upsert_cochange": _with("v_touches", "v_commits", more=_pairs_sql(2)) + "SELECT file_a, file_b, CASE WHEN both_count > 2 THEN both_count * 10 ELSE both_count END AS both_count FROM pairs",
    "file_owners": _with("v_touches", "v_commits", more=f"""w AS (SELECT path, author, count(*) AS changes,
            sum(CAST(round({history.WEIGHT_UNIT}.0::DOUBLE * pow(2.0::DOUBLE, date_diff('day', DATE '{history.LANDMARK}', CAST(author_date AS DATE)) / {history.HALF_LIFE}.0::DOUBLE)) AS HUGEINT)) AS weight FROM v_rows GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY weight DESC, author) AS INTEGER) AS place, sum(weight) OVER (PARTITION BY path) AS whole FROM w)""")
    + "SELECT path, author, CAST(changes AS BIGINT) AS changes, CAST(weight AS DOUBLE) / CAST(whole AS DOUBLE) AS share, place FROM r WHERE place <= 3",
    "file_signals": _with("v_touches", "v_commits", more=f"""s AS (SELECT o_orderkey AS key, {SUBJECT_SQL} AS subject FROM orders),
        x AS (SELECT r.path, r.author_date, coalesce(regexp_matches(s.subject, '{history.FIXES}'), false) AS fix, coalesce(regexp_matches(s.subject, '{history.REVERTS}'), false) AS rev FROM v_rows r JOIN s ON s.key = r.key)""")
    + f"""SELECT path, count(*) AS changes, count(*) FILTER (WHERE fix) AS fixes, count(*) FILTER (WHERE rev) AS reverts, CAST(count(*) FILTER (WHERE fix) AS DOUBLE) / count(*) AS fix_share,
        CAST(date_diff('day', max(CAST(author_date AS DATE)), DATE '{AS_OF}') AS INTEGER) AS age_days FROM x GROUP BY path""",
    "symbol_cube": _with("v_symbols", "v_files") + """SELECT f.language, s.kind, s.is_exported, CAST(grouping_id(f.language, s.kind, s.is_exported) AS BIGINT) AS level, count(*) AS symbols, count(DISTINCT s.name) AS names
        FROM v_symbols s JOIN v_files f ON f.id = s.file_id GROUP BY CUBE (f.language, s.kind, s.is_exported)""",
    "stream_baskets": """
        WITH t AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day, event_type || ':' || CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 AS VARCHAR) AS item FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND props IS NOT NULL AND ts IS NOT NULL),
        u AS (SELECT *, count(*) OVER (PARTITION BY user_id, day) AS size FROM t), k AS (SELECT * FROM u WHERE size <= 50), n AS (SELECT item, count(*) AS n FROM k GROUP BY item),
        b AS (SELECT x.item AS file_a, y.item AS file_b, count(*) AS both_count FROM k x JOIN k y ON x.user_id = y.user_id AND x.day = y.day AND x.item < y.item GROUP BY ALL HAVING count(*) >= 3)
        SELECT b.*, p.n AS a_count, q.n AS b_count FROM b JOIN n p ON p.item = file_a JOIN n q ON q.item = file_b""",
}
