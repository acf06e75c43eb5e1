"""Decayed ownership, signals, cube and sketches, enclosing spans by a sweep, baskets from a stream, and ranges of a git log."""

import datetime
import os
import random
import subprocess

from pyspark.sql import functions as F

from sparkatlas.operators import cube, history, resolve
from sparkatlas.sources import gitlog
from sparkatlas.streaming import baskets
from tests.test_index import write

COMMITS = "seq long, author string, author_date string, subject string, files array<string>"


def test_sweep_equals_pairs(spark):
    rng = random.Random(7)
    symbols = [(i, f, s, s + rng.choice([0, 1, 5, 30, 90])) for i, (f, s) in enumerate((rng.randrange(4), rng.randrange(100)) for _ in range(120))]
    symbols += [(500, 9, 10, 20), (501, 9, 10, 20), (502, 9, 10, 15), (503, 9, None, 5)]
    calls = [(f, o, rng.randrange(-5, 140), f"c{o}") for o, f in enumerate(rng.randrange(5) for _ in range(300))] + [(9, 1, 10, "x"), (9, 2, 15, "y"), (9, 3, 20, "z"), (9, 4, None, "n"), (None, 5, 1, "m")]
    want = set()
    for f, o, at, name in calls:
        inside = [(-s, e, i) for i, g, s, e in symbols if g == f and at is not None and s is not None and s <= at < e]
        if inside:
            want.add((f, o, at, name, min(inside)[2]))
    got = resolve.enclosing(spark.createDataFrame(calls, "file_id long, ord int, start_byte int, callee string"), spark.createDataFrame(symbols, "id long, file_id long, start_byte long, end_byte long"))
    assert got.schema["start_byte"].dataType.simpleString() == "int" and {tuple(r) for r in got.collect()} == want
    assert {o for f, o, *_ in want if f == 9} == {1, 2}


def commits(spark):
    rows = [(0, "ann", "2024-06-01T10:00:00+02:00", "Fix the port", ["a", "b", "a"]), (1, "bob", "2022-01-01T00:00:00Z", 'Revert "x"', ["a"]), (2, "bob", "2021-01-01", "prefixes", ["a"]), (3, "bob", "2021-01-02", None, ["a", "b"]), (4, "cyd", None, "bug", ["b"])]
    return spark.createDataFrame([*rows, (5, "eve", "2024-01-01", "fix", [f"f{i}" for i in range(60)])], COMMITS)


def test_newer_changes_weigh_more_and_parts_add_up(spark):
    c = commits(spark)
    whole = {(r.path, r.author): (r.changes, r.weight) for r in history.decayed(c).collect()}
    halves = history.added(history.decayed(c.where("seq < 2")), history.decayed(c.where("seq >= 2")))
    assert {(r.path, r.author): (r.changes, r.weight) for r in halves.collect()} == whole and ("b", "cyd") not in whole
    got = {(r.path, r.place): (r.author, r.changes) for r in history.owners(halves).collect()}
    assert got == {("a", 1): ("ann", 1), ("a", 2): ("bob", 3), ("b", 1): ("ann", 1), ("b", 2): ("bob", 1)}
    assert sum(r.share for r in history.owners(halves).where("path = 'a'").collect()) == 1.0 and history.owners(halves, 1).count() == 2
    hot = {r.path: r.top_authors for r in history.file_history(c).collect()}
    assert hot["a"] == "bob (3); ann (2)"


def test_signals(spark):
    got = {r.path: (r.changes, r.fixes, r.reverts, r.age_days) for r in history.signals(commits(spark), "2024-06-11").collect()}
    assert got == {"a": (4, 1, 1, 10), "b": (3, 2, 0, 10)}


def test_sketches_merge(spark):
    files = spark.createDataFrame([(0, "go"), (1, "python")], "id long, language string")
    symbols = spark.range(60_000).select("id", (F.col("id") % 2).alias("file_id"), F.when(F.col("id") % 3 == 0, "method").otherwise("function").alias("kind"), F.concat(F.lit("n"), (F.col("id") % 20_000).cast("string")).alias("name"), F.lit(True).alias("is_exported"))
    parts = cube.merged(cube.sketches(symbols.where("id < 25000"), files), cube.sketches(symbols.where("id >= 25000"), files))
    whole = cube.estimates(parts).first()
    assert whole.symbols == 60_000 and abs(whole.names - 20_000) < 0.04 * 20_000
    by = {r.language: r.names for r in cube.estimates(parts, "language").collect()}
    assert all(abs(n - 10_000) < 400 for n in by.values())
    top = {(r.language, r.kind): (r.symbols, r.names) for r in cube.cube(symbols, files).where("level IN (1, 7)").collect()}
    assert top[None, None] == (60_000, 20_000) and top["go", "method"][0] == 10_000


def test_stream_in_pieces_equals_a_batch(spark, tmp_path):
    rng = random.Random(3)
    day = lambda d, h: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    rows = sorted(((rng.randrange(6), f"i{rng.randrange(9)}", day(rng.randrange(5), rng.randrange(24))) for _ in range(300)), key=lambda r: r[2]) + [(None, "i1", day(4, 1)), (1, None, day(4, 1))]
    schema, source, folder = "who long, what string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")

    def add(i, part):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/p{i}")

    def run():
        stream = baskets.touches(spark, f"{source}/*", schema, F.col("who"), F.col("what"), F.col("at"), 1)
        baskets.keep_up(stream, folder).awaitTermination()
        return {(r.actor, r.start, tuple(r.files)) for r in baskets.current(spark, folder).collect()}

    def want(part):
        out = {}
        for who, what, at in part:
            if who is not None and what is not None:
                out.setdefault((who, at.replace(hour=0)), set()).add(what)
        return {(w, a, tuple(sorted(s))) for (w, a), s in out.items()}

    for i in range(3):
        add(i, rows[50 * i : 50 * i + 50])
    assert run() == want(rows[:150])
    add(3, rows[150:])
    assert run() == want(rows) == run()
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{folder}/baskets") if "=" in d)
    spark.read.parquet(f"{folder}/baskets/batch={last}").limit(0).write.mode("overwrite").parquet(f"{folder}/baskets/batch={last + 1}")  # a batch without changes
    assert {(r.actor, r.start, tuple(r.files)) for r in baskets.current(spark, folder).collect()} == want(rows)
    add(5, [(1, "late", day(0, 1)), (1, "i8", day(4, 23))])
    assert not any("late" in f for _, _, f in run())


def test_git_log_in_ranges(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "repo")
    os.makedirs(root)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann Lee", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(7):
        write(root, {"a.py": f"x = {i}\n", f"d/f{i}.py": ""})
        git("add", "-A")
        git("commit", "-qm", f"Fix {i}\n\nmore words")
    git("commit", "-q", "--allow-empty", "-m", "nothing")
    write(root, {f"bulk/f{i}.py": f"{i}" for i in range(60)})
    git("add", "-A")
    git("commit", "-qm", "bulk")
    monkeypatch.setattr(gitlog, "RANGE", 3)
    got = [(r.seq, r.author, r.subject, len(r.files)) for r in gitlog.read_commits(spark, root, None).orderBy("seq").collect()]
    assert got == [(0, "Ann Lee", "bulk", 60), (1, "Ann Lee", "nothing", 0), *((i + 2, "Ann Lee", f"Fix {6 - i}", 2) for i in range(7))]
    assert gitlog.read_commits(spark, root, 4).count() == 4 and gitlog.read_commits(spark, str(tmp_path)) is None
    whole = gitlog.read_commits(spark, root)
    assert {r.path for r in history.file_history(whole).collect()} == {"a.py", *(f"d/f{i}.py" for i in range(7))} and history.cochange(whole, 1).count() == 7
