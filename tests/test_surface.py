"""Command line and server over the index of a small repository."""

import io
import json

import pytest

from sparkatlas import cli, server
from sparkatlas.api import CodeIndex, MissingIndex
from tests.test_index import write

FILES = {
    "core.py": 'def work(a):\n  """Does it."""\n  return a\n',
    "tests/test_core.py": "from core import work\n\ndef test_work():\n  assert work(1)\n",
    "app.py": "from core import work\n\ndef main():\n  work(2)\n  print(3)\n\ndef idle():\n  pass\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    write(root, FILES)
    out = CodeIndex(spark, root, home=str(tmp_path_factory.mktemp("home")))
    out.index()
    return out


def run(index, *argv):
    code, lines = cli.run(index, cli.parser().parse_args(list(argv)))
    return code, "\n".join(lines)


def test_commands(index):
    assert run(index, "symbols", "-n", "wor", "--no-tests") == (0, "  core.py:1-3  work  (function)  def work(a)")
    assert run(index, "symbols", "-k", "struct")[0] == 1
    code, text = run(index, "callers", "work")
    assert code == 0 and "main  app.py:4" in text and "test_work  tests/test_core.py:4" in text
    assert run(index, "callers", "idle") == (0, "idle  app.py:7\n  none found") and run(index, "callers", "nobody")[0] == 1
    assert "print -> unresolved" in run(index, "calls", "main")[1] and "work -> work  core.py" in run(index, "calls", "main")[1]
    code, text = run(index, "refs", "work")
    assert code == 0 and text.count("import 0.90") == 2 and run(index, "refs", "nothing")[0] == 1
    assert "test_work" in run(index, "tests-for", "work")[1] and "main" not in run(index, "tests-for", "work")[1]
    assert "tests     test_work" in run(index, "blast-radius", "work")[1]
    assert run(index, "cochange", "core.py")[0] == 1 and run(index, "hot")[0] == 1
    assert "python: 3 files" in run(index, "stats")[1]
    assert "1. function work  core.py:1" in run(index, "search", "does work")[1] and run(index, "search", "zebra")[0] == 1
    assert run(index, "siblings", "work") == (0, "work  core.py:1\n  none found") and run(index, "siblings", "nobody")[0] == 1


def test_missing_index(spark, tmp_path):
    with pytest.raises(MissingIndex, match="index"):
        run(CodeIndex(spark, str(tmp_path), home=str(tmp_path)), "stats")


def test_server(index):
    ask = [
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-06-18"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "find_symbol", "arguments": {"name": "work"}}}, {"id": 4, "method": "tools/call", "params": {"name": "covering_tests", "arguments": {"symbol": "work"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "repo_map"}}, {"id": 6, "method": "tools/call", "params": {"name": "refs", "arguments": {}}}, {"id": 7, "method": "nope"},
        {"id": 8, "method": "tools/call", "params": {"name": "blast_radius", "arguments": {"symbol": "work"}}}, {"id": 9, "method": "tools/call", "params": {"name": "callers", "arguments": {"symbol": "zzz", "depth": 9}}},
    ]
    out = io.StringIO()
    server.serve(index, io.StringIO("\n".join([*(json.dumps({"jsonrpc": "2.0"} | a) for a in ask), "{bad"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by_id = {r["id"]: r for r in got}
    said = lambda i: by_id[i]["result"]["content"][0]["text"]
    assert len(got) == 10 and [t["name"] for t in by_id[2]["result"]["tools"]] == list(server.NAMES)
    assert "core.py:1-3" in said(3) and "test_work" in said(4) and "python: 3 files" in said(5) and by_id[6]["result"]["isError"]
    assert by_id[7]["error"]["code"] == -32601 and by_id[None]["error"]["code"] == -32700 and "tests:" in said(8) and "knows no" in said(9)
