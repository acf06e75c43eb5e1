"""Type relations against brute force, broken sources, and the index of types in a small repository."""

import os
import random

import pytest

from sparkatlas import indexer
from sparkatlas.api import CodeIndex
from sparkatlas.extract import go, typescript
from sparkatlas.operators import types
from sparkatlas.sources import tree
from sparkatlas.store import Store
from tests.test_index import write


def test_implements_equals_brute_force(spark):
    rng = random.Random(1)
    have = {t: {"close", *(f"m{rng.randrange(8)}" for _ in range(rng.randrange(5)))} for t in range(60)}
    ask = {c: {f"m{rng.randrange(9)}" for _ in range(rng.randrange(4))} | ({"close"} if c % 3 == 0 else set()) for c in range(40)}
    methods = spark.createDataFrame([*((t, m) for t, ms in have.items() for m in ms), (1, None), (None, "m1"), (0, "close"), (0, "close")], "type_id long, member string")
    contracts = spark.createDataFrame([*((c, m) for c, ms in ask.items() for m in ms), (7, None)], "contract_id long, member string")
    got = types.implements(methods, contracts)
    assert {tuple(r) for r in got.select("type_id", "contract_id").collect()} == {(t, c) for t, h in have.items() for c, a in ask.items() if a and a <= h}
    assert got.count() == got.distinct().count() and types.implements(methods.limit(0), contracts).count() == 0


def test_hierarchy_with_circles(spark):
    rng = random.Random(5)
    pairs = {(i, rng.randrange(30)) for i in range(30) for _ in range(2)} | {(40, 41), (41, 40), (42, 42)}
    extends = spark.createDataFrame([*pairs, (50, None), (1, 1)], "type_id long, base_id long")
    pairs |= {(1, 1)}
    least = {}
    for t in {a for a, _ in pairs}:
        level, depth, seen = {b for a, b in pairs if a == t}, 1, set()
        while level - seen:
            for b in level - seen:
                least[t, b] = depth
            seen |= level
            level, depth = {b for a, b in pairs if a in level}, depth + 1
    assert {(r.type_id, r.base_id): r.depth for r in types.ancestors(extends).collect()} == least
    own = [(i, f"f{i % 4}", 100 + i) for i in range(45)] + [(3, "f0", 7), (3, "f0", 8)]
    got = {(r.type_id, r.member): (r.depth, r.from_id, r.method_id) for r in types.inherited(extends, spark.createDataFrame(own, "type_id long, member string, method_id long")).collect()}
    want = {}
    for t in range(45):
        for d, b in [(0, t), *((least[t, b], b) for b in range(60) if (t, b) in least and b != t)]:
            for x, m, i in own:
                if x == b:
                    want[t, m] = min(want.get((t, m), (99, 0, 0)), (d, b, i))
    assert got == want


def test_siblings_by_shared_bases(spark):
    table = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (3, 11), (4, 12), (None, 10)], "type_id long, base_id long")
    got = [(r.sibling, r.shared) for r in types.siblings(table, spark.range(1, 2)).orderBy("sibling").collect()]
    assert got == [(2, 2), (3, 1)] and types.siblings(table, spark.range(1, 2), 1).count() == 1


def test_a_broken_function_loses_only_itself():
    source = b"package p\n\nfunc A() { a() }\n\nfunc B() {\n\tif x {\n\t\tb()\n}\n\nfunc C(n int {\n\tc()\n}\n\nfunc D() { d() }\n"
    found = go.extract(source)
    assert not found[0] and [s["name"] for s in found[1]] == ["A", "B", "D"] and [(e["line"], e["found"]) for e in found[5]] == [(6, "{"), (10, "(")]
    assert [(s["start_line"], s["end_line"]) for s in found[1]] == [(3, 3), (5, 8), (14, 14)]
    whole = go.extract(source.replace(b"n int {", b"n int) {").replace(b"\t\tb()\n", b"\t\tb()\n\t}\n"))
    assert whole[0] and not whole[5] and len(whole[1]) == 4
    ts = typescript.extract(b"class K {\n  a() {\n    if (x) {\n      go();\n  }\n  b() { return c(1; }\n  d() { return 1; }\n}\nfunction e() {}\n")
    assert not ts[0] and {s["qualified_name"] for s in ts[1]} == {"K", "K.a", "K.b", "K.d", "e"}
    assert typescript.extract(b"f(`${a}`); /* never ends")[5] == [{"line": 1, "found": "end"}]


@pytest.mark.parametrize("seed", range(6))
def test_deleted_brackets_keep_the_other_functions(seed):
    rng = random.Random(seed)
    bodies = [f"func F{i}(a int) int {{\n\tif a > {i} {{\n\t\tg(a, h(1))\n\t}}\n\treturn [3]int{{1, 2, 3}}[a]\n}}\n" for i in range(12)]
    hit = rng.randrange(12)
    places = [k for k, c in enumerate(bodies[hit]) if c in "(){}[]"]
    at = rng.choice(places)
    bodies[hit] = bodies[hit][:at] + bodies[hit][at + 1 :]
    found = go.extract(("package p\n\n" + "\n".join(bodies)).encode())
    assert not found[0] and {f"F{i}" for i in range(12) if i != hit} <= {s["name"] for s in found[1]}


REPO = {
    "io/io.go": "package io\n\ntype Closer interface {\n\tClose() error\n}\n\ntype File interface {\n\tCloser\n\tRead(n int) int\n}\n",
    "dev/a.go": "package dev\n\ntype Base struct {\n\tn int\n}\n\nfunc (b *Base) Close() error { return nil }\n\ntype Disk struct {\n\t*Base\n}\n\nfunc (d Disk) Read(n int) int { return n }\n",
    "dev/b.go": "package dev\n\ntype Pipe struct {\n\tx int\n}\n\nfunc (p Pipe) Read(n int) int { return n }\n",
    "dev/c.go": "package dev\n\nfunc (p Pipe) Close() error { return nil }\n",
    "web/k.ts": "export interface Shape { area(): number; }\nexport class Square implements Shape { area() { return 1; } }\nexport class Circle implements Shape { area() { return 3; } }\n",
    "py/m.py": "class Animal:\n  def say(self): pass\n\nclass Dog(Animal):\n  pass\n",
}


def test_index_of_types(spark, tmp_path):
    root = str(tmp_path / "repo")
    write(root, REPO)
    index = CodeIndex(spark, root, home=str(tmp_path / "home"))
    index.index()
    names = {r.id: r.qualified_name for r in index.table("symbols").collect()}
    edges = lambda: {(names[r.type_id], names.get(r.base_id), r.kind, r.resolution) for r in index.table("type_edges").collect()}
    want = {
        ("File", "Closer", "embeds", "same_file"), ("Disk", "Base", "embeds", "same_file"), ("Square", "Shape", "implements", "same_file"), ("Circle", "Shape", "implements", "same_file"), ("Dog", "Animal", "extends", "same_file"),
        ("Base", "Closer", "implements", "method_set"), ("Disk", "Closer", "implements", "method_set"), ("Pipe", "Closer", "implements", "method_set"), ("Disk", "File", "implements", "method_set"), ("Pipe", "File", "implements", "method_set"),
    }
    assert edges() == want
    assert {(r.qualified_name, r.shared) for r in index.siblings("Disk").collect()} >= {("Pipe", 2)} and [r.qualified_name for r in index.siblings("Square").collect()] == ["Circle"]
    os.remove(os.path.join(root, "dev/c.go"))
    index.index()
    assert edges() == {x for x in want if x[0] != "Pipe"}


def test_updates_open_what_changed_alone(spark, tmp_path):
    root, store = str(tmp_path / "repo"), Store(spark, str(tmp_path / "ix"))
    files = {f"pkg/d{i}/f.py": f"def f{i}():\n  return {i}\n" for i in range(20)}
    write(root, files)
    past = lambda path, t: os.utime(os.path.join(root, path), (t, t))
    for p in files:
        past(p, 1_000_000_000)
    indexer.index(spark, root, store)
    idle = indexer.index(spark, root, store)
    assert (idle.opened_files, idle.opened_bytes, idle.unchanged) == (0, 0, 20)
    write(root, {"pkg/d3/f.py": "def g3():\n  return 333\n"})
    past("pkg/d3/f.py", 1_000_000_500)
    past("pkg/d5/f.py", 1_000_000_500)  # a new time, the old contents
    step = indexer.index(spark, root, store)
    assert (step.opened_files, step.opened_bytes, step.reindexed, step.unchanged) == (2, 23 + len(files["pkg/d5/f.py"]), 1, 19)
    assert indexer.index(spark, root, store).opened_files == 0
    assert {r.name for r in store.read("symbols").collect()} == {"g3", *(f"f{i}" for i in range(20) if i != 3)}


def test_tree_takes_filters(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"a/x.py": "x", "a/b/y.go": "package y", "a/b/z.ts": "z", "c/d.py": "d", "top.py": "t"})
    read = tree.read_tree(spark, root)
    plan = read.where("path LIKE 'a/%' AND language IN ('go', 'python')")
    assert {r.path for r in plan.collect()} == {"a/x.py", "a/b/y.go"}
    assert {r.path for r in read.where("language = 'go'").collect()} == {"a/b/y.go"} and {r.path for r in read.where("path LIKE 'a/b/z%' AND size_bytes > 0").collect()} == {"a/b/z.ts"}
    assert list(tree.directories(root, "a/b/")) == [".", "a", "a/b"] and list(tree.directories(root, "top")) == ["."]
    looked = tree.read_tree(spark, root, contents=False)
    assert looked.where("content IS NULL AND content_hash IS NULL AND size_bytes > 0").count() == 5
    assert {r.path: r.content for r in tree.open_files(looked.where("language = 'ts' OR path = 'top.py'"), root).collect()} == {"top.py": b"t"}
