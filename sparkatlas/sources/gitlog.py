"""Data source ``git_log``: the commits of a repository, newest first; its head, and the module line of ``go.mod``.

    spark.dataSource.register(GitLog)
    spark.read.format("git_log").load("/path/of/repo")

The driver asks git for the head and the number of commits alone. Executors read ranges of the history below that head,
so the repository must lie on storage they share; no list of commits passes through the driver.
"""

from __future__ import annotations

import io
import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema

#: Newest commits that are mined unless told otherwise; seconds that git gets to count them, and for its head.
MAX_COMMITS, LOG_SECONDS, HEAD_SECONDS = 5000, 120, 10
RECORD, FIELD = "\x1e", "\x1f"
#: Commits of a partition, and of an Arrow batch.
RANGE, BATCH = 1000, 500


def _git(root: str, *args: str, seconds: int) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def parse_log(lines: Iterator[str], seq: int = 0) -> Iterator[tuple[int, str, str, str, list[str]]]:
    """(seq, author, date, subject, files) of the lines of a log, newest first; a commit without files is kept."""
    head, files = None, []
    for line in lines:
        if line.startswith(RECORD):
            if head is not None:
                yield (seq, *head, files)
                seq += 1
            author, day, subject = (line[1:].rstrip("\n").split(FIELD, 2) + ["", ""])[:3]
            head, files = (author, day.strip(), subject), []
        elif head is not None and line.strip():
            files.append(line.strip())
    if head is not None:
        yield (seq, *head, files)


class _Range(InputPartition):
    def __init__(self, skip: int, size: int):
        super().__init__(None)
        self.skip, self.size = skip, size


class _Reader(DataSourceReader):
    def __init__(self, root: str, limit: int | None):
        self.root, self.limit, self.head = root, limit, head(root)

    def partitions(self) -> list[InputPartition]:
        n = _git(self.root, "rev-list", "--count", "--no-merges", self.head, seconds=LOG_SECONDS) if self.head else None
        n = int(n or 0) if self.limit is None else min(int(n or 0), self.limit)
        return [_Range(at, min(RANGE, n - at)) for at in range(0, n, RANGE)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        columns = pa.schema([("seq", pa.int64()), ("author", pa.string()), ("author_date", pa.string()), ("subject", pa.string()), ("files", pa.list_(pa.string()))])
        wanted = ["git", "-C", self.root, "log", self.head, "--no-merges", "--name-only", f"--format={RECORD}%an{FIELD}%aI{FIELD}%s", f"--skip={partition.skip}", f"-n{partition.size}"]
        with subprocess.Popen(wanted, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as log:
            held: list[tuple] = []
            lines = io.TextIOWrapper(log.stdout, encoding="utf-8", errors="replace", newline="\n")
            for row in parse_log(lines, partition.skip):
                held.append(row)
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist([dict(zip(columns.names, r, strict=True)) for r in held], schema=columns)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(columns.names, r, strict=True)) for r in held], schema=columns)
        if log.returncode:
            raise RuntimeError(f"git log of {self.root} ended with {log.returncode}")  # the task is tried again


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return schema.COMMITS

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("limit")
        return _Reader(os.path.abspath(self.options["path"]), None if limit in (None, "") else int(limit))


def read_commits(spark: SparkSession, root: str, limit: int | None = MAX_COMMITS) -> DataFrame | None:
    """The newest ``limit`` commits but merges (None: all of them); None where there is no git history."""
    if head(root) is None:
        return None
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("limit", "" if limit is None else str(limit)).load(os.path.abspath(root))


def head(root: str) -> str | None:
    text = _git(root, "rev-parse", "HEAD", seconds=HEAD_SECONDS)
    return text.strip() or None if text else None


def go_module(root: str) -> str | None:
    try:
        with open(os.path.join(root, "go.mod"), encoding="utf-8", errors="replace") as f:
            found = re.search(r"^\s*module\s+(\S+)", f.read(), re.M)
    except OSError:
        return None
    return found[1] if found else None
