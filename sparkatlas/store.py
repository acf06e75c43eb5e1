"""The index on disk: parquet tables in version folders and one pointer that names the tables in force.

A build writes new tables beside the old and then swaps the pointer, so readers see all of a build or nothing of it, and
tables that did not change are not written again. The tables of the build before are kept for readers that still hold them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import schema

POINTER = "_CURRENT"


def locate(repo: str, home: str | None = None) -> str:
    """``<home>/<name>-<8 hex digits of the path's hash>``."""
    full = os.path.realpath(repo)
    return os.path.join(home or os.path.expanduser("~/.sparkatlas"), f"{os.path.basename(full)}-{hashlib.sha1(full.encode()).hexdigest()[:8]}")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and self.root.startswith(os.path.expanduser("~/")):
            raise RuntimeError("name a folder for the index that all executors share; the default one is the driver's own")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._staged: list[str] = []

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def exists(self) -> bool:
        return self._fs().exists(self._path(POINTER))

    def manifest(self) -> dict:
        if not self.exists():
            return {"tables": {}, "before": []}
        stream = self._fs().open(self._path(POINTER))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """A table; empty if the index hasn't got it yet."""
        at = self.manifest()["tables"].get(name)
        if at is None:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return self.spark.read.schema(schema.TABLES[name]).parquet(f"{self.root}/{at}")

    def stage(self, df: DataFrame) -> DataFrame:
        """``df`` written once to the index folder and read back, until :meth:`publish`."""
        at = f"stage-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.root}/{at}")
        self._staged.append(at)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{at}")

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """Write the tables given, keep the others, and put all in force at once."""
        old, version = self.manifest(), f"v-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            kinds = dict(c.strip().split(" ") for c in schema.TABLES[name].split(","))
            df.selectExpr(*(f"CAST({c} AS {'bigint' if k == 'long' else k}) AS {c}" for c, k in kinds.items())).write.parquet(f"{self.root}/{version}/{name}")
        new = old["tables"] | {n: f"{version}/{n}" for n in tables}
        left = sorted(set(old["tables"].values()) - set(new.values()))
        self._swap(json.dumps({"tables": new, "before": left}))
        for at in [*(b for b in old["before"] if b not in new.values()), *self._staged]:
            self._fs().delete(self._path(at), True)
        self._staged = []

    def _swap(self, text: str) -> None:
        """Write the pointer beside its place and rename it over the old one."""
        fresh = self._path(f"{POINTER}-{uuid.uuid4().hex[:12]}")
        stream = self._fs().create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf).rename(fresh, self._path(POINTER), options)
