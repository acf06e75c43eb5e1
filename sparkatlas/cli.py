"""Command line: ``python -m sparkatlas <command>``."""

from __future__ import annotations

import argparse
import sys

from . import render
from .api import CodeIndex, MissingIndex
from .session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkatlas", description="Code intelligence over a repository's index.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *args: str, repo: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help)
        if repo:
            p.add_argument("repo", nargs="?", default=".")
        for a in args:
            p.add_argument(a)
        if not repo:
            p.add_argument("--repo", default=".")
        p.add_argument("--db", help="folder of the index")
        return p

    p = command("index", "build the index or bring it up to date", repo=True)
    p.add_argument("--full", action="store_true")
    p.add_argument("--strict", action="store_true", help="resolve every call again, as a full build would")
    p = command("symbols", "list symbols")
    p.add_argument("--file", "-f")
    p.add_argument("--name", "-n")
    p.add_argument("--kind", "-k")
    p.add_argument("--exported", action="store_true")
    p.add_argument("--no-tests", action="store_true")
    p.add_argument("--limit", type=int, default=200)
    command("stats", "sizes and resolution of the index")
    command("callers", "who calls a symbol", "symbol").add_argument("--depth", "-d", type=int, default=1)
    command("calls", "what a symbol calls", "symbol")
    command("refs", "call sites of a name", "name").add_argument("--limit", type=int, default=200)
    p = command("cochange", "files that change together with a file", "file")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--min-lift", type=float, default=2.0)
    command("tests-for", "tests that reach a symbol", "symbol")
    command("blast-radius", "all that a change of a symbol may touch", "symbol")
    command("siblings", "types that share a symbol's bases and contracts", "symbol")
    command("search", "symbols by words of their names and docs", "text").add_argument("--limit", type=int, default=20)
    command("hot", "files that change most").add_argument("--limit", type=int, default=15)
    command("mcp", "serve the index over standard input and output", repo=True)
    return top


def _needs(rows: list, lines: list[str], note: str) -> tuple[int, list[str]]:
    return (0, lines) if rows else (1, [note])


def _of_symbol(index: CodeIndex, a) -> tuple[int, list[str]]:
    """Commands about a symbol: an unknown one is an error, one without results is not."""
    targets = index.find(a.symbol).collect()
    if not targets:
        return 1, [f"the index knows no {a.symbol}"]
    if a.command == "callers":
        lines = render.callers(index.callers(a.symbol, a.depth).collect())
    elif a.command == "tests-for":
        lines = render.callers(index.tests_for(a.symbol).collect())
    elif a.command == "calls":
        lines = render.calls(index.calls(a.symbol).collect())
    elif a.command == "siblings":
        lines = [f"  {r.qualified_name}  {r.path}  ({r.shared} shared)" for r in index.siblings(a.symbol).collect()]
    else:
        lines = [f"  {r.layer:9} {r.label}  {r.path}" for r in index.blast_radius(a.symbol).collect()]
    return 0, [f"{t.qualified_name}  {t.path}:{t.start_line}" for t in targets] + (lines or ["  none found"])


def run(index: CodeIndex, a) -> tuple[int, list[str]]:
    """(exit code, lines) of a parsed command."""
    if a.command == "index":
        r = index.index(a.full, a.strict)
        out = [f"{r.mode}: {r.files} files, {r.symbols} symbols, {r.parse_errors} parse errors in {r.seconds:.1f} s"]
        out += [f"  {r.reindexed} parsed, {r.unchanged} unchanged, {r.deleted} deleted, {r.dependents} dependents resolved again"] if r.mode == "incremental" else []
        out += ["  skipped: " + ", ".join(f"{k} {v}" for k, v in sorted(r.skipped.items()))] if r.skipped else []
        return 0, out + [f"  {k}: {v}" for k, v in sorted(r.resolutions.items())] + ([f"  {r.commits} commits, {r.bulk_commits} of them too large to count"] if r.commits else [])
    index.require()
    if a.command in ("callers", "calls", "tests-for", "blast-radius", "siblings"):
        return _of_symbol(index, a)
    if a.command == "symbols":
        rows = index.symbols(path=a.file, name=a.name, kind=a.kind, exported=a.exported, no_tests=a.no_tests, limit=a.limit).collect()
        return _needs(rows, render.definitions(rows), "no symbols")
    if a.command == "search":
        rows = index.ranked(a.text, a.limit).collect()
        return _needs(rows, [f"  {r.rank}. {r.kind} {r.qualified_name}  {r.path}:{r.start_line}" for r in rows], f"nothing holds a word of: {a.text}")
    if a.command == "refs":
        rows = index.refs(a.name, a.limit).collect()
        return _needs(rows, render.refs(rows), f"no call of {a.name}")
    if a.command == "cochange":
        rows = index.cochange(a.file, a.limit, a.min_lift).collect()
        return _needs(rows, render.partners(rows), f"nothing changes together with {a.file}")
    if a.command == "hot":
        rows = index.hot(a.limit).collect()
        return _needs(rows, render.hot(rows), "no history")
    return 0, render.stats(index)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    index = CodeIndex(session(spark__ui__showConsoleProgress="false"), a.repo, a.db)
    if a.command == "mcp":
        from .server import serve

        serve(index, sys.stdin, sys.stdout)
        return 0
    try:
        code, lines = run(index, a)
    except MissingIndex as e:
        code, lines = 1, [str(e)]
    print("\n".join(lines), file=sys.stderr if code else sys.stdout)
    return code
