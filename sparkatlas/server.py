"""The index as tools over line-delimited JSON-RPC on standard input and output."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from . import render
from .api import CodeIndex

PROTOCOL = "2025-06-18"
#: Bounds of one answer: targets of a name, levels of callers.
TARGETS, DEPTH = 5, 3


def _first(near: DataFrame, size: int) -> list[Row]:
    """The first ``size`` rows of each of the first TARGETS targets; no more than that many leave the executors."""
    order = ("depth", "path", "qualified_name", "id")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(*order))).where(F.col("place") <= size)
    rows = near.orderBy("target", *order).limit(TARGETS * size).collect()
    first = sorted({r.target for r in rows})[:TARGETS]
    return [r for r in rows if r.target in first]


class Tools:
    def __init__(self, index: CodeIndex):
        self.index = index

    def find_symbol(self, name: str, kind: str = "", limit: int = 20) -> str:
        """Definitions whose name contains the text, with file, lines and signature. Use it in place of a text search for
        where something is defined. Kinds: function, method, class, struct, interface, type, type_alias."""
        rows = self.index.symbols(name=name, kind=kind or None, limit=limit).collect()
        return _text(f"'{name}' is defined in {len(rows)} place(s):", render.definitions(rows), f"nothing is named like '{name}'")

    def callers(self, symbol: str, depth: int = 1) -> str:
        """Who calls a symbol, up to three calls away, with the line and the confidence of the evidence."""
        if self.index.find(symbol).isEmpty():
            return f"the index knows no '{symbol}'"
        rows = _first(self.index.callers(symbol, max(1, min(depth, DEPTH))), 40)
        return _text(f"called by, for {symbol}:", render.callers(rows), f"no called by, for {symbol} found")

    def refs(self, name: str, limit: int = 40) -> str:
        """Every call site of exactly this name, resolved or not."""
        return _text(f"call sites of '{name}':", render.refs(self.index.refs(name, limit).collect()), f"no call sites of '{name}'")

    def blast_radius(self, symbol: str) -> str:
        """What a change of a symbol may touch: callers within two calls, files that change with its file, its tests."""
        first = self.index.find(symbol).first()
        if first is None:
            return f"the index knows no '{symbol}'"
        near = self.index.callers(symbol, 2).where(f"target = {first.id}")
        parts = (
            ("callers:", render.callers(near.limit(25).collect())),
            ("changes together with:", render.partners(self.index.cochange(first.path, 10).collect())),
            ("tests:", render.callers(near.where("is_test").limit(15).collect())),
        )
        return "\n".join(["\n".join([f"{first.qualified_name}  {first.path}:{first.start_line}"]), *(_text(title, lines, f"{title} none") for title, lines in parts)])

    def cochange(self, file: str, limit: int = 15) -> str:
        """Files that commits change together with a file, by the end of its path."""
        return _text(f"changes together with {file}:", render.partners(self.index.cochange(file, limit, 2.0).collect()), f"nothing changes together with {file}")

    def covering_tests(self, symbol: str) -> str:
        """Tests that reach a symbol within two calls."""
        if self.index.find(symbol).isEmpty():
            return f"the index knows no '{symbol}'"
        rows = _first(self.index.tests_for(symbol), 20)
        return _text(f"tests of {symbol}:", render.callers(rows), f"no tests reach {symbol}")

    def hot_files(self, limit: int = 10) -> str:
        """The files that commits change most, with their main authors."""
        return _text("most changed files:", render.hot(self.index.hot(limit).collect()), "no history")

    def repo_map(self) -> str:
        """An overview: languages, symbols, the directories with most definitions and the files that change most."""
        out = render.stats(self.index) + ["directories:"] + [f"  {r.dir}: {r.n}" for r in self.index.directories(8).collect()]
        busy = self.index.hot(5).collect()
        return "\n".join(out + (["most changed files:", *(f"  {r.path} ({r.change_count} commits)" for r in busy)] if busy else []))


NAMES = ("find_symbol", "callers", "refs", "blast_radius", "cochange", "covering_tests", "hot_files", "repo_map")


def _text(title: str, lines: list[str], nothing: str) -> str:
    return "\n".join([title, *lines]) if lines else nothing


def _describe(name: str, tool: Callable) -> dict:
    kinds = {"str": "string", "int": "integer"}
    args = inspect.signature(tool).parameters
    properties = {n: {"type": kinds[p.annotation]} | ({} if p.default is p.empty else {"default": p.default}) for n, p in args.items()}
    return {"name": name, "description": " ".join(tool.__doc__.split()), "inputSchema": {"type": "object", "properties": properties, "required": [n for n, p in args.items() if p.default is p.empty]}}


def answer(tools: Tools, request: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkatlas", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [_describe(n, getattr(tools, n)) for n in NAMES]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    if params.get("name") not in NAMES:
        return reply | {"error": {"code": -32602, "message": f"unknown tool {params.get('name')}"}}
    try:
        tools.index.require()
        text, failed = getattr(tools, params["name"])(**(params.get("arguments") or {})), False
    except Exception as e:  # a failed tool must not end the session
        text, failed = f"{type(e).__name__}: {e}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(index: CodeIndex, lines: IO[str], out: IO[str]) -> None:
    tools = Tools(index)
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except (ValueError, AttributeError):
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a request"}}
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)
