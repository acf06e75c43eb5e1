"""Queries over source files made from ``part``: one Python, Go or TypeScript file for every part, and what extraction must find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extract

#: By kind of file: its language, the suffix and the text, in which @ stands for the part's key and # for its size.
TEXTS = {
    "python": (
        "python",
        ".py",
        "import pkg.m#\nfrom lib import f# as g\n\nclass C@:\n    def run(self, x):\n        return self.step(x) + g(x)\n\n    def step(self, x):\n        return x\n\ndef _top@():\n    return C@().run(1)\n",
    ),
    "go": (
        "go",
        ".go",
        'package p#\n\nimport (\n\t"fmt"\n\tal "ex.org/m/x#"\n)\n\n// T@ holds.\ntype T@ struct {\n\tn int\n}\n\nfunc (t *T@) Run(x int) int {\n\tfmt.Println(x)\n\treturn t.step(x)\n}\n\n'
        "func (t *T@) step(x int) int { return al.Twice(x) }\n\nfunc New@() *T@ {\n\treturn &T@{}\n}\n",
    ),
    "typescript": (
        "typescript",
        ".ts",
        "import Base, { use as ut } from './b#';\n\nexport interface Opt@ {\n  a: string;\n}\n\nexport class K@ extends Base {\n  run(x: number): number {\n    return this.step(x) + ut(x);\n  }\n"
        "  private step(x: number): number {\n    return x;\n  }\n}\n\nexport const arrow@ = (x: number) => ut(x);\n\nfunction local@() {\n  return arrow@(2);\n}\n",
    ),
    "python_deep": (
        "python",
        ".py",
        '"""Mod."""\nimport a.b.c#\nfrom ..up import (x as y, z)\n\nclass D@(Base#, mixins.Mix):\n    """Doc of @.\n\n    More.\n    """\n\n    async def _go(self, n: int = 1) -> "int":\n'
        "        def inner(k):\n            return self.go(k)\n        return inner(n)\n",
    ),
    "python_broken": ("python", ".py", "def ok@():\n    return 1\n\ndef bad@(:\n    return ok@()\n\nclass C@:\n    def f(self):\n        return self.g()\n\n    def h(self:\n        return 2\n\n    def g(self):\n        return ok@()\n"),
    "go_deep": (
        "go",
        ".go",
        "package p#\n\ntype (\n\t// ID@ names.\n\tID@ uint64\n\tAny@[T any] struct {\n\t\t*Base#\n\t\tio.Reader\n\t\tn T\n\t}\n)\n\ntype I@ interface {\n\tfmt.Stringer\n\tMove(x int) (int, error)\n}\n\n"
        "func (a *Any@[T]) Move(x int) (int, error) {\n\tvar p Port#\n\tq := &tools.Slot{}\n\trun := func() { a.step(); q.Open() }\n\tp.Close()\n\treturn x, run\n}\n",
    ),
    "go_broken": (
        "go",
        ".go",
        "package p#\n\nfunc Bad@() {\n\tif x {\n\t\tfoo@()\n}\n\nfunc Lost@(a int {\n\treturn a\n}\n\ntype E@ struct {\n\tn int\n}\n\nfunc More@() {\n\tbar()\n\t}\n}\n\nfunc (e E@) Get() int { return e.Twice(#) }\n",
    ),
    "ts_broken": (
        "typescript",
        ".ts",
        "export class W@ extends lib.Base#<string> implements One, Two<A> {\n  run(x) {\n    if (x) {\n      go@(x);\n  }\n  bad() { return twice(2;\n  }\n  fine(): number { return this.run(1); }\n}\n"
        "export interface P@ extends Q { m(x: number): void; f: string }\nfunction lost@( {\nexport function kept@() { return new W@().fine(); }\n",
    ),
    "tsx": ("tsx", ".tsx", "import { use } from './u#';\n\n/** Shows @. */\nexport function App@(p: Props) {\n  const [a] = use(#);\n  return <ul className='x'>{list@(a)}</ul>;\n}\n"),
}
KINDS = list(TEXTS)

#: What each text holds. Symbols: name, qualified name, kind, first and last line, exported, docstring, signature.
SYMBOLS = {
    "python": [
        ("C@", "C@", "class", 4, 9, True, None, "class C@"), ("run", "C@.run", "method", 5, 6, True, None, "def run(self, x)"), ("step", "C@.step", "method", 8, 9, True, None, "def step(self, x)"),
        ("_top@", "_top@", "function", 11, 12, False, None, "def _top@()"),
    ],
    "go": [
        ("T@", "T@", "struct", 9, 11, True, "T@ holds.", "type T@ struct"), ("Run", "T@.Run", "method", 13, 16, True, None, "func (t *T@) Run(x int) int"),
        ("step", "T@.step", "method", 18, 18, False, None, "func (t *T@) step(x int) int"), ("New@", "New@", "function", 20, 22, True, None, "func New@() *T@"),
    ],
    "typescript": [
        ("Opt@", "Opt@", "interface", 3, 5, True, None, "interface Opt@"), ("K@", "K@", "class", 7, 14, True, None, "class K@ extends Base"), ("run", "K@.run", "method", 8, 10, True, None, "run(x: number): number"),
        ("step", "K@.step", "method", 11, 13, False, None, "private step(x: number): number"), ("arrow@", "arrow@", "function", 16, 16, True, None, "const arrow@ = (x: number) =>"), ("local@", "local@", "function", 18, 20, False, None, "function local@()"),
    ],
    "python_deep": [
        ("D@", "D@", "class", 5, 14, True, "Doc of @.\n\nMore.", "class D@(Base#, mixins.Mix)"), ("_go", "D@._go", "method", 11, 14, False, None, 'async def _go(self, n: int = 1) -> "int"'),
        ("inner", "D@._go.inner", "function", 12, 13, True, None, "def inner(k)"),
    ],
    "python_broken": [
        ("ok@", "ok@", "function", 1, 2, True, None, "def ok@()"), ("C@", "C@", "class", 7, 15, True, None, "class C@"), ("f", "C@.f", "method", 8, 9, True, None, "def f(self)"), ("g", "C@.g", "method", 14, 15, True, None, "def g(self)"),
    ],
    "go_deep": [
        ("ID@", "ID@", "type", 5, 5, True, "ID@ names.", "type ID@ uint64"), ("Any@", "Any@", "struct", 6, 10, True, None, "type Any@ struct"), ("I@", "I@", "interface", 13, 16, True, None, "type I@ interface"),
        ("Move", "Any@.Move", "method", 18, 24, True, None, "func (a *Any@[T]) Move(x int) (int, error)"),
    ],
    "go_broken": [
        ("Bad@", "Bad@", "function", 3, 6, True, None, "func Bad@()"), ("E@", "E@", "struct", 12, 14, True, None, "type E@ struct"), ("More@", "More@", "function", 16, 19, True, None, "func More@()"),
        ("Get", "E@.Get", "method", 21, 21, True, None, "func (e E@) Get() int"),
    ],
    "ts_broken": [
        ("W@", "W@", "class", 1, 9, True, None, "class W@ extends lib.Base#<string> implements One, Two<A>"), ("run", "W@.run", "method", 2, 5, True, None, "run(x)"), ("bad", "W@.bad", "method", 6, 7, True, None, "bad()"),
        ("fine", "W@.fine", "method", 8, 8, True, None, "fine(): number"), ("P@", "P@", "interface", 10, 10, True, None, "interface P@ extends Q"), ("kept@", "kept@", "function", 12, 12, True, None, "function kept@()"),
    ],
    "tsx": [("App@", "App@", "function", 4, 7, True, "Shows @.", "function App@(p: Props)")],
}
#: Calls: callee, receiver, type of the receiver, line.
CALLS = {
    "python": [("step", "self", "C@", 6), ("g", None, None, 6), ("run", "C@()", None, 12), ("C@", None, None, 12)],
    "go": [("Println", "fmt", None, 14), ("step", "t", "T@", 15), ("Twice", "al", None, 18)],
    "typescript": [("step", "this", "K@", 9), ("ut", None, None, 9), ("ut", None, None, 16), ("arrow@", None, None, 19)],
    "python_deep": [("go", "self", "D@", 13), ("inner", None, None, 14)],
    "python_broken": [("g", "self", "C@", 9), ("ok@", None, None, 15)],
    "go_deep": [("step", "a", "Any@", 21), ("Open", "q", None, 21), ("Close", "p", "Port#", 22)],
    "go_broken": [("foo@", None, None, 5), ("bar", None, None, 17), ("Twice", "e", "E@", 21)],
    "ts_broken": [("go@", None, None, 4), ("twice", None, None, 6), ("run", "this", "W@", 8), ("fine", "new W@()", None, 12)],
    "tsx": [("use", None, None, 5), ("list@", None, None, 6)],
}
#: Imports: module, symbol, alias, line.
IMPORTS = {
    "python": [("pkg.m#", None, "pkg", 1), ("lib", "f#", "g", 2)],
    "go": [("fmt", None, "fmt", 4), ("ex.org/m/x#", None, "al", 5)],
    "typescript": [("./b#", "default", "Base", 1), ("./b#", "use", "ut", 1)],
    "python_deep": [("a.b.c#", None, "a", 2), ("..up", "x", "y", 3), ("..up", "z", "z", 3)],
    "tsx": [("./u#", "use", "use", 1)],
}
#: Relations: owner, kind, name, line.
RELATIONS = {
    "typescript": [("K@", "extends", "Base", 7)],
    "python_deep": [("D@", "extends", "Base#", 5), ("D@", "extends", "Mix", 5)],
    "go_deep": [("Any@", "embeds", "Base#", 7), ("Any@", "embeds", "Reader", 8), ("I@", "embeds", "Stringer", 14), ("I@", "requires", "Move", 15)],
    "ts_broken": [("W@", "extends", "Base#", 1), ("W@", "implements", "One", 1), ("W@", "implements", "Two", 1), ("P@", "extends", "Q", 10), ("P@", "requires", "m", 10)],
}
#: Faults: line and what has no partner.
ERRORS = {
    "python_broken": [(4, "block"), (7, "block")],
    "go_broken": [(4, "{"), (8, "("), (18, "}")],
    "ts_broken": [(3, "{"), (6, "("), (11, "("), (11, "{")],
}


def _extracted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The files of all parts, dealt anew by path: parsing is the work here, and a small table has few partitions."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"), (F.col("p_partkey") % len(KINDS) + 1).cast("int").alias("l"))
    pick = lambda i: F.element_at(F.array(*[F.lit(TEXTS[x][i]) for x in KINDS]), F.col("l"))
    text = F.replace(F.replace(pick(2), F.lit("@"), F.col("k")), F.lit("#"), F.col("s"))
    raw = part.select(
        F.concat(F.lit("src/f"), "k", pick(1)).alias("path"), pick(0).alias("language"), F.length(text).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("mtime"), F.lit(1).alias("line_count"),
        F.sha2(text, 256).alias("content_hash"), F.lit(False).alias("is_test"), F.lit(None).cast("string").alias("skipped_reason"), text.cast("binary").alias("content"),
    )
    return extract.extract(raw.repartition(4 * spark.sparkContext.defaultParallelism, "path"), (kind,))


def _found(kind: str, *columns: str):
    return lambda spark, d: _extracted(spark, d, kind).select("path", F.explode(kind).alias("x")).select("path", *[F.col(f"x.{c}") for c in columns])


_COLUMNS = {
    "symbols": ("name", "qualified_name", "kind", "start_line", "end_line", "is_exported", "docstring", "signature"),
    "calls": ("callee", "receiver", "receiver_type_hint", "line"),
    "imports": ("module", "symbol", "alias", "line"),
    "relations": ("owner", "kind", "name", "line"),
    "errors": ("line", "found"),
}


def _sql(kind: str, rows: dict[str, list[tuple]]) -> str:
    def value(v) -> str:
        if v is None:
            return "CAST(NULL AS VARCHAR)"
        if not isinstance(v, str):
            return f"CAST({v} AS {'BOOLEAN' if isinstance(v, bool) else 'INTEGER'})"
        quoted = v.replace("'", "''")
        return f"replace(replace('{quoted}', '@', CAST(p_partkey AS VARCHAR)), '#', CAST(p_size AS VARCHAR))"

    return " UNION ALL ".join(
        f"SELECT 'src/f' || p_partkey || '{TEXTS[x][1]}' AS path, " + ", ".join(f"{value(v)} AS {c}" for c, v in zip(_COLUMNS[kind], r, strict=True)) + f" FROM part WHERE p_partkey % {len(KINDS)} = {i}"
        for i, x in enumerate(KINDS)
        for r in rows.get(x, ())
    )


def _parsed(spark, d):
    """How many files of each language parse, and the faults of those that don't."""
    return _extracted(spark, d, "errors").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.count_if("parse_ok").alias("parsed"), F.sum(F.size("errors")).cast("long").alias("faults"))


_FAULTS = " ".join(f"WHEN {i} THEN {len(ERRORS[x])}" for i, x in enumerate(KINDS) if x in ERRORS)
_LANGUAGES = " ".join(f"WHEN {i} THEN '{TEXTS[x][0]}'" for i, x in enumerate(KINDS))

QUERIES = {f"extract_{k}": _found(k, *c) for k, c in _COLUMNS.items()} | {"extract_parsed": _parsed}
ORACLE = {f"extract_{k}": _sql(k, rows) for k, rows in (("symbols", SYMBOLS), ("calls", CALLS), ("imports", IMPORTS), ("relations", RELATIONS), ("errors", ERRORS))}
ORACLE["extract_parsed"] = f"""
    WITH f AS (SELECT CASE p_partkey % {len(KINDS)} {_LANGUAGES} END AS language, CASE p_partkey % {len(KINDS)} {_FAULTS} ELSE 0 END AS n FROM part)
    SELECT language, count(*) AS files, count(*) FILTER (WHERE n = 0) AS parsed, CAST(sum(n) AS BIGINT) AS faults FROM f GROUP BY language"""
