"""The server in a process of its own, the index command, tools over history, and a name that stops being unique."""

import json
import os
import subprocess
import sys

from sparkatlas import cli, indexer, server
from sparkatlas.api import CodeIndex
from sparkatlas.store import Store
from tests.conftest import ROOT
from tests.test_index import edges, write


def committed(root, times):
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann Lee", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    os.makedirs(root, exist_ok=True)
    git("init", "-q")
    for i in range(times):
        write(root, {"api.py": f"def api():\n  return {i}\n", "schema.sql": f"{i}"})
        git("add", "-A")
        git("commit", "-qm", f"c{i}")
        write(root, {"notes.md": f"{i}"})
        git("add", "-A")
        git("commit", "-qm", f"n{i}")
    write(root, {f"bulk/f{i}.txt": "x" for i in range(60)} | {"api.py": "def api():\n  return 0\n"})
    git("add", "-A")
    git("commit", "-qm", "bulk")


def test_commands_and_tools_over_history(spark, tmp_path):
    root = str(tmp_path / "repo")
    committed(root, 5)
    index = CodeIndex(spark, root, home=str(tmp_path / "home"))
    code, lines = cli.run(index, cli.parser().parse_args(["index", root]))
    assert code == 0 and lines[0].startswith("full: 1 files, 1 symbols, 0 parse errors") and "11 commits, 1 of them too large" in lines[-1]
    assert cli.run(index, cli.parser().parse_args(["index", root, "--strict"]))[1][0].startswith("incremental: 1 files")
    assert cli.run(index, cli.parser().parse_args(["cochange", "api.py", "--min-lift", "1"])) == (0, ["  schema.sql  5 commits  confidence 100%  lift 2.0"])
    assert "api.py  5 commits" in "\n".join(cli.run(index, cli.parser().parse_args(["hot"]))[1])
    tools = server.Tools(index)
    assert "schema.sql" in tools.cochange("api.py") and "notes.md" in tools.hot_files() and "api" in tools.refs("api") and "bulk" not in tools.hot_files()


def test_a_second_definition_makes_a_unique_name_unresolved(spark, tmp_path):
    root, store = str(tmp_path / "repo"), Store(spark, str(tmp_path / "ix"))
    write(root, {"a/use.py": "def main():\n  lonely()\n", "b/one.py": "def lonely():\n  pass\n"})
    indexer.index(spark, root, store)
    assert edges(store) == {("main", "lonely", "lonely", "name_only")}
    write(root, {"c/two.py": "def lonely():\n  return 2\n"})
    assert indexer.index(spark, root, store).dependents == 1 and edges(store) == {("main", "lonely", None, "unresolved")}
    os.remove(os.path.join(root, "c/two.py"))
    indexer.index(spark, root, store)
    assert edges(store) == {("main", "lonely", "lonely", "name_only")}


def test_server_process(tmp_path):
    root, home = str(tmp_path / "repo"), str(tmp_path / "home")
    write(root, {"core.py": "def work():\n  return 1\n"})
    env = os.environ | {"HOME": home, "PYTHONPATH": ROOT}
    os.makedirs(home)
    made = subprocess.run([sys.executable, "-m", "sparkatlas", "index", root], env=env, capture_output=True, text=True, timeout=240)
    assert made.returncode == 0 and made.stdout.startswith("full: 1 files")
    ask = [{"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-06-18"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "find_symbol", "arguments": {"name": "work"}}}]
    done = subprocess.run([sys.executable, "-m", "sparkatlas", "mcp", root], env=env, input="\n".join(json.dumps({"jsonrpc": "2.0"} | a) for a in ask) + "\n", capture_output=True, text=True, timeout=240)
    got = {r["id"]: r for r in map(json.loads, done.stdout.splitlines())}  # nothing but the protocol goes to standard output
    assert got[1]["result"]["protocolVersion"] == "2025-06-18" and len(got[2]["result"]["tools"]) == len(server.NAMES) and "core.py:1-2" in got[3]["result"]["content"][0]["text"]
    missing = subprocess.run([sys.executable, "-m", "sparkatlas", "stats", "--repo", home], env=env, capture_output=True, text=True, timeout=240)
    assert missing.returncode == 1 and "no index" in missing.stderr
