"""Lineage cuts and Arrow helpers of the corpus operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, remove, shared_dir

__all__ = ["cut", "drop_cut", "join_groups", "shared_dir", "slices", "text_rows"]


def drop_cut(df: DataFrame) -> None:
    """Remove a table written by :func:`cut` that nothing will read again."""
    path = getattr(df, "cut_path", None)
    if path:
        remove(df.sparkSession, path)


#: Groups with more than this part of all rows are fewer than as many, whatever the table: they are sent to every task.
HOT_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, salt: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row a ``key`` and its number of rows in ``size``, both written tables.

    A key with a large share of the rows is joined by broadcast and its rows are dealt by ``salt``, so that no task gets
    them all; the other keys are shuffled as usual. Columns of ``groups`` must not be null.
    """
    least = (groups.agg(F.sum(size).alias("n")).first().n or 0) // HOT_GROUPS
    names = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > least).select(key, F.struct(*names).alias("hot_"))
    rest = groups.where(F.col(size) <= least).select(F.col(key).alias("at_"), F.struct(*names).alias("rest_"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("at_", F.when(F.col("hot_").isNull(), F.col(key)).otherwise(F.xxhash64(salt)))
    found = dealt.join(rest, "at_", "left").withColumn("group_", F.coalesce("hot_", "rest_")).where("group_ IS NOT NULL")
    return found.select(*rows.columns, *[F.col(f"group_.{c}").alias(c) for c in names])


#: Rows, and bytes of Arrow data, whose values are Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 500, 4_000_000


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES):
    """Parts of an Arrow batch, of about ``size`` bytes or one row, that are small as Python objects too."""
    step = max(1, min(SLICE_ROWS, size * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def text_rows(batch: pa.RecordBatch, key: str = "doc_id", text: str = "text", more: str | None = None):
    """(key, text or '') for every row of an Arrow batch, and the value of ``more`` if it is named; a slice at a time."""
    for part in slices(batch):
        keys, texts = part.column(key).to_pylist(), (t or "" for t in part.column(text).to_pylist())
        yield from zip(keys, texts, strict=True) if more is None else zip(keys, texts, part.column(more).to_pylist(), strict=True)
