"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sparkatlas", **conf: str) -> SparkSession:
    """The running session, or a new one; source files travel in Arrow batches bounded by bytes, not rows alone."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
