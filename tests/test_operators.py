"""Operators of the code index on small fixtures, and the star-schema queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkatlas.functions.text import directory_bucket, like_ci
from sparkatlas.operators import graph, history, incremental, resolve, search
from sparkatlas.plans import corpus, extraction, retrieval, types

SF = "/root/testdata/sf0.001"


def commits(spark, rows):
    return spark.createDataFrame([(i, a, f"2024-01-{28 - i:02d}", f) for i, (a, f) in enumerate(rows)], "seq long, author string, author_date string, files array<string>")


def test_cochange_lift_and_bulk(spark):
    rows = [("ann", ["api", "schema"])] * 4 + [("bob", ["noise"])] * 6 + [("bob", [f"f{i}" for i in range(60)])]
    got = history.cochange(commits(spark, rows)).collect()
    assert [(r.file_a, r.file_b, r.both_count, r.conf_ab, r.lift) for r in got] == [("api", "schema", 4, 1.0, 2.5)]
    hot = search.hot_files(history.file_history(commits(spark, rows)), 1).collect()[0]
    assert (hot.path, hot.change_count, hot.top_authors) == ("noise", 6, "bob (6)")


def test_callers_depth_cycle_and_self(spark):
    edges = spark.createDataFrame([(1, 2, 5, 0.9), (2, 3, 7, 0.9), (3, 3, 1, 0.9), (3, 1, 2, 0.5)], "src_symbol_id long, dst_symbol_id long, line int, confidence double")
    target = spark.range(3, 4)
    assert {r.id: r.depth for r in graph.callers(edges, target, 1).collect()} == {2: 1, 3: 1}
    assert {r.id: r.depth for r in graph.callers(edges, target, 3).collect()} == {2: 1, 3: 1, 1: 2}
    assert graph.callers(edges, spark.range(9, 10), 2).count() == 0


def test_callers_of_many_targets_in_a_deep_walk(spark):
    chain = spark.range(60).selectExpr("id + 1 AS src_symbol_id", "id AS dst_symbol_id", "1 AS line", "0.9D AS confidence")
    got = graph.callers(chain, spark.range(1), 50).collect()
    assert {r.id: r.depth for r in got} == {i: i for i in range(1, 51)}
    assert graph.callers(chain, spark.range(58, 59), 50).count() == 2  # ends where nothing new is reached
    star = spark.range(1000).selectExpr("id + 5000 AS src_symbol_id", "id AS dst_symbol_id", "1 AS line", "0.9D AS confidence")
    many = graph.callers(star, spark.range(1000).selectExpr("id AS target", "id"), 3).collect()
    assert sorted((r.target, r.id, r.depth) for r in many) == [(i, i + 5000, 1) for i in range(1000)]


def test_like_is_ascii_folded_with_live_wildcards(spark):
    df = spark.createDataFrame([("DEVICE.go",), ("É",), ("axb",), ("a.b\\c",)], "p string")
    hit = lambda pattern: [r.p for r in df.where(like_ci(df.p, pattern)).collect()]
    assert hit("%device.go") == ["DEVICE.go"] and hit("é") == [] and hit("%a_b") == ["axb"] and hit("a.b\\c") == ["a.b\\c"]
    dirs = spark.createDataFrame([("x.py",), ("a/x.py",), ("a/b/c/x.py",)], "p string").select(directory_bucket(F.col("p")).alias("d"))
    assert [r.d for r in dirs.collect()] == ["(root)", "a", "a/b"]


def test_module_candidates(spark):
    one = spark.range(1)
    py = lambda m, d: one.select(resolve.python_candidates(F.lit(m), F.lit(d)).alias("c")).collect()[0].c
    assert py("a.b", "x") == ["a/b.py", "a/b/__init__.py", "src/a/b.py", "src/a/b/__init__.py"]
    assert py(".util", "pkg/sub")[0] == "pkg/sub/util.py" and py("..util", "pkg/sub")[0] == "pkg/util.py"
    ts = lambda m, d: one.select(resolve.typescript_candidates(F.lit(m), F.lit(d)).alias("c")).collect()[0].c
    assert ts("../lib/x.js", "src/app")[:2] == ["src/lib/x.ts", "src/lib/x.tsx"] and ts("react", "src") == [] and ts("./x.ts", "src")[0] == "src/x.ts"


def test_incremental_diff_and_upsert(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    b = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, content_hash string")
    assert {r.path: r.status for r in incremental.diff(a, b).collect()} == {"a": "deleted", "b": "changed", "c": "unchanged", "d": "new"}
    assert {tuple(r) for r in incremental.upsert(a, b, ["path"]).collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")}


def rows(result, columns):
    text = lambda v: "" if v is None or v != v else f"{float(v):.10g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in result), columns


QUERIES = corpus.QUERIES | extraction.QUERIES | retrieval.QUERIES | types.QUERIES
ORACLE = corpus.ORACLE | extraction.ORACLE | retrieval.ORACLE | types.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "customer", "supplier", "documents", "benchmark", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert rows([tuple(r) for r in df.select(*columns).collect()], columns) == rows(want, columns)
