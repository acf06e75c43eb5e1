"""Sources, extractors and the index of a small repository, built in full and maintained."""

import os
import subprocess

import pytest

from sparkatlas import indexer
from sparkatlas.extract import go, python, typescript
from sparkatlas.sources import gitlog, tree
from sparkatlas.store import Store, locate

GO = b'''package card

import (
	"fmt"
	tools "example.com/m/pkg/tools"
)

// Card is one card.
// It is shared.
type Card struct {
	ID string
}

type Mover interface {
	Move() error
}

type cardID uint64

// Shift moves it.
func (c *Card) Shift() error {
	c.align(1)
	slot := &tools.Slot{}
	slot.Open()
	run := func() { var p Port; p.Close(); slot.Open() }
	return fmt.Errorf("x (%s", run)
}

func (s Stack[K, V]) Top(k K) (V, error) { return tools.Pick(s.m[k]) }
'''

TS = b'''import Base, { useThing as ut, type Kind } from './base';
import * as ns from "./util";

/** What it takes. */
export interface Options { url: string; go(x: number): void; }

export type Handler = (req: string) => Promise<void>;

/**
 * Loads it.
 */
export async function load(url: string): Promise<{ a: string }> {
  return await ns.get<string>(`x ${ut(1)} y`).then(() => new Foo(url).bar());
}

function local(): void {}

export const handler = async (req: string) => {
  return req;
};

export class Client extends Base<{ a: 1 }> {
  /** Connects. */
  connect(opts: Options): void { this.stop(); if (/a"(/.test(x)) { local(); } }

  private stop(): void { super.stop(); }
}
'''


def by_name(found):
    return {s["qualified_name"]: s for s in found[1]}


def called(found):
    return {(c["callee"], c["receiver"], c["receiver_type_hint"]) for c in found[2]}


def test_go():
    found = go.extract(GO)
    s = by_name(found)
    assert found[0] and {n: r["kind"] for n, r in s.items()} == {"Card": "struct", "Mover": "interface", "cardID": "type", "Card.Shift": "method", "Stack.Top": "method"}
    assert s["Card"]["docstring"] == "Card is one card.\nIt is shared." and s["cardID"]["docstring"] is None
    assert s["cardID"]["signature"] == "type cardID uint64" and s["Card.Shift"]["signature"] == "func (c *Card) Shift() error"
    assert s["Card"]["is_exported"] and not s["cardID"]["is_exported"] and s["Card.Shift"]["parent"] == "Card"
    assert called(found) == {("align", "c", "Card"), ("Open", "slot", "Slot"), ("Close", "p", "Port"), ("Open", "slot", None), ("Errorf", "fmt", None), ("Pick", "tools", None)}
    assert [(i["module"], i["alias"]) for i in found[3]] == [("fmt", "fmt"), ("example.com/m/pkg/tools", "tools")]


def test_typescript():
    found = typescript.extract(TS)
    s = by_name(found)
    assert found[0]
    assert {n: r["kind"] for n, r in s.items()} == {
        "Options": "interface", "Handler": "type_alias", "load": "function", "local": "function", "handler": "function", "Client": "class", "Client.connect": "method", "Client.stop": "method"
    }
    assert {n for n, r in s.items() if not r["is_exported"]} == {"local", "Client.stop"}
    assert s["load"]["docstring"] == "Loads it." and s["handler"]["signature"].startswith("const handler") and s["Options"]["docstring"] == "What it takes."
    assert {("stop", "this", "Client"), ("local", None, None), ("get", "ns", None), ("ut", None, None), ("bar", "new Foo(url)", None), ("stop", "super", None)} <= called(found)
    assert "Foo" not in {c for c, _, _ in called(found)}
    assert [(i["symbol"], i["alias"]) for i in found[3]] == [("default", "Base"), ("useThing", "ut"), ("Kind", "Kind"), (None, "ns")]


def test_python_whole_and_broken():
    text = b'import a.b\nfrom ..m import x as y\n@dec(1)\nclass A:\n  """What.\n\n  More.\n  """\n  class B:\n    def f(self, a=":") -> int:\n      def g(): pass\n      return self.h(a)\n  async def _p(self): ...\n'
    found = python.extract(text)
    s = by_name(found)
    assert found[0] and {n: r["kind"] for n, r in s.items()} == {"A": "class", "A.B": "class", "A.B.f": "method", "A.B.f.g": "function", "A._p": "method"}
    assert s["A"]["start_line"] == 3 and s["A"]["docstring"] == "What.\n\nMore." and s["A.B.f"]["signature"] == 'def f(self, a=":") -> int'
    assert ("h", "self", "B") in called(found) and not s["A._p"]["is_exported"]
    assert [(i["module"], i["symbol"], i["alias"]) for i in found[3]] == [("a.b", None, "a"), ("..m", "x", "y")]
    broken = python.extract(b"def ok():\n  return 1\n\ndef bad(:\n  x\n\ndef fine(a):\n  return ok()\n")
    assert not broken[0] and set(by_name(broken)) == {"ok", "fine"}


def test_python_keeps_what_is_intact_in_a_broken_class():
    text = b"class A:\n    def f(self):\n        return self.g()\n\n    def bad(self:\n        return 1 +\n\n    class B:\n        x = = 2\n\n        def h(self): return top()\n\n    def g(self):\n        return 2\n\ndef top():\n    return 3\n"
    found = python.extract(text)
    s = by_name(found)
    assert not found[0] and {"A", "A.f", "A.B", "A.B.h", "A.g", "top"} == set(s)
    assert (s["A.g"]["start_line"], s["A.g"]["end_line"]) == (13, 14) and ("g", "self", "A") in called(found) and ("top", None, None) in called(found)


def test_typescript_calls_with_long_type_arguments():
    fields = "; ".join(f"f{i}: Map<string, number>" for i in range(30))
    source = f"function run(a: number, b: number) {{\n  load<{{ {fields} }}>(a);\n  if (a < b && b > (a)) {{ stop(); }}\n  make<{{ {fields} }}>().go();\n}}\n"
    ok, _, calls, *_ = typescript.extract(source.encode())
    assert ok and sorted(c["callee"] for c in calls) == ["go", "load", "make", "stop"]


@pytest.mark.parametrize("one", [python.extract, go.extract, typescript.extract, typescript.extract_tsx])
def test_extractors_bear_anything(one):
    for data in (b"", b"\xff\xfe{", b"}}}(((", b"`${`${", b"func func type (", b"class", b"import {", b"/*", b"'", "é = 'ü'; f(é)".encode(), GO[:200], TS[:300], b"x" * 100_000, b"(" * 5000):
        one(data)


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_tree(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"src/__init__.py": "", "src/ok.py": "a = 1\nb", "node_modules/x.ts": "x", ".hid/y.py": "", ".dot.py": "", "notes.md": "", "gen.go": "// Code generated by x\n", "nul.py": b"\0", "big.py": b"a" * (2 * 1024 * 1024 + 1), "tests/t.py": "x", "a/b_test.go": "package a", "B.spec.TSX": "x"})
    got = {r.path: r for r in tree.read_tree(spark, root).collect()}
    assert set(got) == {"src/__init__.py", "src/ok.py", ".dot.py", "gen.go", "nul.py", "big.py", "tests/t.py", "a/b_test.go", "B.spec.TSX"}
    assert {p: r.skipped_reason for p, r in got.items() if r.skipped_reason} == {"gen.go": "generated", "nul.py": "binary", "big.py": "too_large"}
    assert {p for p, r in got.items() if r.is_test} == {"tests/t.py", "a/b_test.go", "B.spec.TSX"}
    assert got["src/ok.py"].line_count == 2 and got["big.py"].content_hash == "" and len(got["gen.go"].content_hash) == 64 and got["gen.go"].content is None


FILES = {
    "pkg/core.py": '"""Core."""\ndef helper(a):\n  return a\n\nclass Engine:\n  def run(self):\n    return self.step()\n  def step(self):\n    return helper(1)\n',
    "pkg/use.py": "from pkg.core import helper\nimport json\n\ndef main():\n  json.dumps(helper(2))\n  lonely_name()\n",
    "tests/test_core.py": "from pkg.core import helper\n\ndef test_helper():\n  assert helper(1)\n",
    "go.mod": "module example.com/m\n",
    "pkg/tools/tools.go": "package tools\n\nfunc Pick(a int) int { return inner(a) }\n",
    "pkg/tools/inner.go": "package tools\n\nfunc inner(a int) int { return a }\n",
    "cmd/main.go": 'package main\n\nimport "example.com/m/pkg/tools"\n\nfunc start() { tools.Pick(1) }\n',
    "web/a.ts": "import { go as g } from './b';\nexport class K { m() { this.n(); g(); } n() {} }\n",
    "web/b.ts": "export function go() { console.log(1); }\n",
}


def edges(store):
    s = {r.id: r.qualified_name for r in store.read("symbols").collect()}
    return {(s[r.src_symbol_id], r.dst_name, s[r.dst_symbol_id] if r.dst_symbol_id is not None else None, r.resolution) for r in store.read("edges").collect()}


def test_build_and_update(spark, tmp_path):
    root, store = str(tmp_path / "repo"), Store(spark, locate(str(tmp_path / "repo"), str(tmp_path / "home")))
    write(root, FILES)
    assert not store.exists()
    first = indexer.index(spark, root, store)
    assert (first.mode, first.files, first.parse_errors, first.commits) == ("full", 8, 0, 0)
    want = {
        ("Engine.run", "step", "Engine.step", "receiver"), ("Engine.step", "helper", "helper", "same_file"), ("main", "helper", "helper", "import"), ("main", "dumps", None, "unresolved"),
        ("main", "lonely_name", None, "unresolved"), ("test_helper", "helper", "helper", "import"), ("Pick", "inner", "inner", "package"), ("start", "Pick", "Pick", "import"),
        ("K.m", "n", "K.n", "receiver"), ("K.m", "g", "go", "import"), ("go", "log", None, "unresolved"),
    }
    assert edges(store) == want
    again = indexer.index(spark, root, store)
    assert (again.mode, again.reindexed, again.unchanged) == ("incremental", 0, 8) and edges(store) == want
    write(root, {"pkg/core.py": FILES["pkg/core.py"].replace("def helper", "def renamed"), "pkg/new.py": "def lonely_name():\n  pass\n"})
    os.remove(os.path.join(root, "web/b.ts"))
    third = indexer.index(spark, root, store)
    assert (third.reindexed, third.deleted, third.unchanged) == (2, 1, 6) and third.dependents == 3
    got = edges(store)
    assert ("main", "helper", None, "unresolved") in got and ("main", "lonely_name", "lonely_name", "name_only") in got and ("K.m", "g", None, "unresolved") in got
    ids = {r.id for r in store.read("symbols").collect()}
    assert all(r.dst_symbol_id in ids for r in store.read("edges").where("dst_symbol_id IS NOT NULL").collect())
    other = Store(spark, str(tmp_path / "other"))
    indexer.build(spark, root, other)
    assert edges(other) == got
    assert indexer.update(spark, root, other, strict=True).reindexed == 0


def test_history_of_git(spark, tmp_path):
    root, store = str(tmp_path / "repo"), Store(spark, str(tmp_path / "ix"))
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann Lee", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    os.makedirs(root)
    git("init", "-q")
    for i in range(4):
        write(root, {"schema.sql": f"{i}", "api.py": f"x = {i}\n"})
        git("add", "-A")
        git("commit", "-qm", f"c{i}")
    for i in range(6):
        write(root, {"noise.md": f"{i}"})
        git("add", "-A")
        git("commit", "-qm", f"n{i}")
    result = indexer.index(spark, root, store)
    assert result.commits == 10
    row = store.read("cochange").collect()
    assert [(r.file_a, r.file_b, r.both_count, r.lift) for r in row] == [("api.py", "schema.sql", 4, 2.5)]
    assert {r.path: (r.change_count, r.top_authors) for r in store.read("file_history").collect()}["noise.md"] == (6, "Ann Lee (6)")
    assert {r.key: r.value for r in store.read("meta").collect()}["commit_sha"] == gitlog.head(root)
    assert gitlog.read_commits(spark, str(tmp_path / "nothing")) is None
