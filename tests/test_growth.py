"""What must grow no faster than the input: rows that steps make, and results at depths and sizes the small tables don't reach."""

import itertools
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from sparkatlas import extract
from sparkatlas.operators import history, resolve, retrieval, types
from sparkatlas.plans import types as type_plans


def test_equal_sets_are_divided_once(spark):
    rng = random.Random(3)
    have = {t: {f"m{rng.randrange(6)}" for _ in range(3)} | {"other"} for t in range(60)}
    ask = {c: {f"m{c % 6}", f"m{c % 3}"} for c in range(90)}
    methods = spark.createDataFrame([(t, m) for t, ms in have.items() for m in ms], "type_id long, member string")
    contracts = spark.createDataFrame([(c, m) for c, ms in ask.items() for m in ms], "contract_id long, member string")
    d = types.divide(methods, contracts)
    want = {(t, c) for t, h in have.items() for c, a in ask.items() if a <= h}
    assert {tuple(r) for r in types.implements(methods, contracts).collect()} == want
    sets = {(frozenset(have[t] - {"other"}), frozenset(ask[c])) for t, c in want}
    assert d.met.count() == len(sets) < len(want) / 20
    plain = types.siblings(spark.createDataFrame(sorted(want), "type_id long, base_id long"), spark.range(7, 9), 10)
    assert sorted(map(tuple, types.contract_siblings(d, spark.range(7, 9), 10).collect())) == sorted(map(tuple, plain.collect()))


def test_contracts_come_to_the_types(spark, monkeypatch):
    """Of types and contracts no pair is shuffled, with any number of slices, and the contracts of a class follow each other."""
    rng = random.Random(4)
    have = {t: {f"m{rng.randrange(6)}" for _ in range(3)} for t in range(80)}
    ask = {c: {f"m{c % 6}", f"m{c % 3}"} for c in range(90)}
    methods = spark.createDataFrame([(t, m) for t, ms in have.items() for m in ms], "type_id long, member string")
    contracts = spark.createDataFrame([(c, m) for c, ms in ask.items() for m in ms], "contract_id long, member string")
    want = sorted((t, c) for t, h in have.items() for c, a in ask.items() if a <= h)
    monkeypatch.setattr(types, "SLICE", 40, raising=False)
    sizes = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in sizes:
        spark.conf.set(k, "-1")
    try:
        found = types.implements(methods, contracts)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want
        monkeypatch.setattr(types, "SLICE", 1000)
        rows = types.implements(methods, contracts).rdd.glom().collect()
        groups = [[g for g, _ in itertools.groupby(part, lambda r: (r.contract_id % 6, r.type_id))] for part in rows]
        assert sorted((r.type_id, r.contract_id) for part in rows for r in part) == want and all(len(g) == len(set(g)) for g in groups)
        classes = [[c for c, _ in itertools.groupby(g, lambda k: k[0])] for g in groups]
        assert all(len(c) == len(set(c)) for c in classes)
    finally:
        for k in sizes:
            spark.conf.unset(k)


def test_hierarchies_deeper_than_the_queries_go(spark, tmp_path):
    keys = spark.createDataFrame([(3**k,) for k in range(34)], "p_partkey long").selectExpr("p_partkey", "CAST(p_partkey % 2 AS INT) AS p_size")
    keys.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    rows = type_plans.QUERIES["type_ancestors"](spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == sorted(con.execute(f"SELECT {', '.join(rows.columns)} FROM ({type_plans.ORACLE['type_ancestors']})").fetchall())


def test_inherited_rows_are_members_not_ancestors(spark):
    """A chain of 40 types that all have the one member: every type keeps its own, and nothing goes down."""
    chain = spark.range(40).selectExpr("id AS type_id", "id + 1 AS base_id")
    own = spark.range(41).selectExpr("id AS type_id", "'f' AS member", "id * 2 AS method_id")
    assert {tuple(r) for r in types.inherited(chain, own).collect()} == {(t, "f", t * 2, t, 0) for t in range(41)}


def test_small_files_share_a_batch_and_large_ones_do_not():
    blank = {"path": "a.py", "language": "python", "size_bytes": 1, "mtime": None, "line_count": 1, "content_hash": "h", "is_test": False, "skipped_reason": None}
    kinds = pa.schema([*extract._fields(extract._META), ("content", pa.binary())])
    body = [b"def f():\n  return g(1)\n", None, b"# " + b"x" * extract.PIECE_BYTES + b"\ndef h():\n  pass\n"]
    rows = [blank | {"id": i, "content": body[2 if i == 50 else i % 2]} for i in range(100)]
    whole = list(extract._rows(iter([pa.RecordBatch.from_pylist(rows, schema=kinds)])))
    assert [b.num_rows for b in whole] == [51, 49]
    got = [x for b in whole for x in b.to_pylist()]
    assert [x["id"] for x in got] == list(range(100)) and all([s["name"] for s in x["symbols"]] == ([["f"], [], ["h"]][2 if x["id"] == 50 else x["id"] % 2]) for x in got)
    calls = [x for b in extract._rows(iter([pa.RecordBatch.from_pylist(rows, schema=kinds)]), ("calls",)) for x in b.to_pylist()]
    assert "symbols" not in calls[0] and [x["calls"] for x in calls] == [x["calls"] for x in got]


def test_commits_are_dealt_by_number(spark, monkeypatch):
    commits = spark.range(0, 1000, 1, 1).selectExpr("id AS seq", "'a' AS author", "'2001-01-01' AS author_date", "transform(sequence(0, id % 3), i -> 'f' || (id * 7 + i) % 40) AS files")
    before = sorted(map(tuple, history.cochange(commits).collect()))
    assert history.baskets(commits).rdd.getNumPartitions() == 1
    monkeypatch.setattr(history, "TASK_COMMITS", 100)
    sizes = history.baskets(commits).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 300
    assert before and sorted(map(tuple, history.cochange(commits).collect())) == before


def test_search_keeps_the_best_in_each_task(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    docs = spark.range(0, 400, 1, 3).selectExpr("id", "concat('all w', id % 7, ' v', id % 11) AS text")
    asked = spark.range(12).selectExpr("id AS query_id", "concat('all w', id % 7, ' v', id) AS text")
    index = retrieval.build(docs)
    terms = asked.selectExpr("query_id", "explode(split(text, ' ')) AS term").join(index.postings, "term")
    want = terms.groupBy("query_id", "key").agg(F.sum("impact").alias("score")).orderBy("query_id", F.desc("score"), "key").collect()
    best = {q: [(r.key, r.score) for r in want if r.query_id == q][:4] for q in range(12)}
    got = retrieval.search(index, asked, 4)
    assert {q: [(r.key, r.score) for r in got.where(f"query_id = {q}").orderBy("rank").collect()] for q in (0, 6, 11)} == {q: best[q] for q in (0, 6, 11)}
    seen = []
    monkeypatch.setattr(retrieval, "ranked", lambda scores, order, k: seen.append(scores.count()) or scores)
    retrieval.search(index, asked, 4)
    assert seen[0] <= 12 * 4 * 4 < len(want) / 10


def test_ladder_moves_calls_few_times(spark):
    """Calls are the long table: six lookups at most may join it, and one more its bindings."""
    files = spark.createDataFrame([(1, "a/x.py", "python"), (2, "b/y.py", "python")], "id long, path string, language string")
    symbols = spark.createDataFrame([(10, 1, "f", "f", "function", 0), (20, 2, "g", "g", "function", 0), (21, 2, "h", "K.h", "method", 5)], "id long, file_id long, name string, qualified_name string, kind string, start_byte long")
    binds = spark.createDataFrame([(1, "z", "g", 2, None), (1, "y", "*", 2, None)], "file_id long, alias string, symbol string, resolved_file_id long, go_dir string")
    calls = [("f", None, None, 10, "same_file"), ("z", None, None, 20, "import"), ("g", "y", None, 20, "import"), ("h", None, "K", 21, "receiver"), ("g", None, None, 20, "name_only"), ("none", None, None, None, "unresolved")]
    rows = spark.createDataFrame([(1, i, *c[:3], i, 10) for i, c in enumerate(calls)], "file_id long, ord long, callee string, receiver string, receiver_type_hint string, line int, src_symbol_id long")
    found = resolve.resolve(rows, symbols, files, binds)
    assert [(r.dst_symbol_id, r.resolution) for r in found.orderBy("line").collect()] == [c[3:] for c in calls]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 7


def _written(spark, run) -> int:
    """Bytes that ``run`` shuffles."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = total()
    run()
    return total() - before


def test_ladder_moves_calls_of_decided_rungs_once(spark):
    """Calls of names in their own file, and calls of a common name that nothing tells, are moved to their file and no further."""
    files = spark.range(50).selectExpr("id", "concat('d', id % 5, '/f', id, '.py') AS path", "'python' AS language")
    symbols = spark.range(500).selectExpr("id", "id % 50 AS file_id", "concat('name', id DIV 50 + id % 50 DIV 25 * 5) AS name", "concat('K.n', id) AS qualified_name", "'function' AS kind", "id AS start_byte")
    binds = spark.createDataFrame([(1, "z", "g", 2, None)], "file_id long, alias string, symbol string, resolved_file_id long, go_dir string")
    calls = spark.range(0, 100_000, 1, 4).selectExpr("id % 50 AS file_id", "id AS ord", "concat('name', hash(id) & 15) AS callee", "CAST(NULL AS STRING) AS receiver", "CAST(NULL AS STRING) AS receiver_type_hint", "CAST(hash(id, 1) & 1023 AS INT) AS line", "xxhash64(id) AS src_symbol_id")
    sizes = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in sizes:
        spark.conf.set(k, "-1")
    try:
        once = _written(spark, lambda: calls.repartition("file_id").write.format("noop").mode("overwrite").save())
        moved = _written(spark, lambda: resolve.resolve(calls, symbols, files, binds).write.format("noop").mode("overwrite").save())
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert 0 < moved < 3 * once


def test_ladder_equals_brute_force(spark):
    rng = random.Random(8)
    pick = rng.choice
    files = [(i, f"d{i % 4}/f{i}", pick(["python", "go", "typescript", None])) for i in range(12)]
    home = {i: (path.split("/")[0], language) for i, path, language in files}
    symbols = [(i, rng.randrange(14), pick(["a", "b", "c", "d", f"u{i}", None]), f"{pick('KLM')}.{pick('abcd')}{pick(['', i])}", pick(["method", "function"]), rng.randrange(8) * 10, rng.randrange(1, 10) * 10) for i in range(90)]
    known = [s for s in symbols if s[1] in home]
    names, quals = [s[2] for s in symbols if s[2]], [s[3].split(".") for s in symbols]
    binds = [(f, alias, pick([None, "*", "default", *names]), pick([None, *range(14)]), pick([None, "d0", "d1", "d9"])) for f in range(14) for alias in ("m", "n", "a", "u5", "z")]
    calls = []
    for i in range(3000):
        kind, name = rng.randrange(3), pick(["a", "b", "c", "z", "none", None, *names])
        hint = None
        if kind == 0:
            hint, name = pick([*quals, ["K", "none"], ["K", "a"]])
        calls.append((pick([*range(14), None]), i, name, pick([None, None, "m", "n", "self"]), hint, i, pick([None, *range(0, 100, 5)])))
    at = {(f, a): b for f, a, *b in binds}
    want = []
    for f, i, name, receiver, hint, line, start in calls:
        around = [s for s in symbols if s[1] == f and start is not None and s[5] <= start < s[6]]
        if f not in home or not around:
            continue
        src = min(around, key=lambda s: (-s[5], s[6], s[0]))[0]
        folder, language = home[f]
        ids = lambda test: sorted(s[0] for s in known if test(s))
        inside = lambda file, n: next((s[0] for s in sorted(known, key=lambda s: (s[5], s[0])) if file is not None and n is not None and s[1] == file and s[2] == n), None)
        bare, found = receiver is None, None
        b = at.get((f, name if bare else receiver), (None, None, None))
        q = ids(lambda s: hint is not None and s[3] == f"{hint}.{name}")
        d = ids(lambda s: name is not None and s[2] == name and home[s[1]][0] == (folder if bare and language == "go" else None if bare else b[2]))
        u = ids(lambda s: name is not None and s[2] == name and (bare or s[4] == "method"))
        own, far = inside(f, name), inside(b[1], b[0] if bare else name)
        if q:
            qd = ids(lambda s: s[3] == f"{hint}.{name}" and home[s[1]][0] == folder)
            found = (q[0], 0.95, "receiver") if len(q) == 1 else (qd[0], 0.9, "receiver") if len(qd) == 1 else (None, 0.0, "unresolved")
        elif bare and language == "go" and d:
            found = (d[0], 0.95, "package") if len(d) == 1 else (None, 0.0, "unresolved")
        elif bare and language not in ("go", None) and own is not None:
            found = (own, 0.9, "same_file")
        elif bare and language not in ("go", None) and b[0] not in (None, "*", "default") and far is not None:
            found = (far, 0.9, "import")
        elif not bare and len(d) == 1:
            found = (d[0], 0.9, "import")
        elif not bare and far is not None:
            found = (far, 0.9, "import")
        elif len(u) == 1:
            found = (u[0], 0.5, "name_only")
        want.append((line, src, name, *(found or (None, 0.0, "unresolved"))))
    rows = spark.createDataFrame(calls, "file_id long, ord long, callee string, receiver string, receiver_type_hint string, line int, start_byte long")
    table = spark.createDataFrame(symbols, "id long, file_id long, name string, qualified_name string, kind string, start_byte long, end_byte long")
    others = (table, spark.createDataFrame(files, "id long, path string, language string"), spark.createDataFrame(binds, "file_id long, alias string, symbol string, resolved_file_id long, go_dir string"))
    for asked in (rows, resolve.enclosing(rows, table)):
        got = resolve.resolve(asked, *others)
        assert got.schema["line"].dataType.simpleString() == "int"
        assert sorted((r.line, r.src_symbol_id, r.dst_name, r.dst_symbol_id, r.confidence, r.resolution) for r in got.collect()) == sorted(want)
    assert {w[5] for w in want} == {"receiver", "package", "same_file", "import", "name_only", "unresolved"}
