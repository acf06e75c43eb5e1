"""Baskets kept up from a stream: what an actor touches within a window, upserted batch by batch.

Each micro-batch writes the baskets that it changed to a folder of its own number, over whatever an earlier attempt at
that batch left there. A reader takes of every basket the version of the largest batch number. So a batch that is run
again changes nothing, and any cut of the stream into batches gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Files of a source read in one micro-batch.
FILES_A_BATCH = 8


def touches(spark: SparkSession, path: str, schema: StructType | str, actor: Column, item: Column, at: Column, files_a_batch: int = FILES_A_BATCH) -> DataFrame:
    """A stream of (actor, item, at) from the Parquet file, folder or pattern ``path``; rows without one of the three drop out."""
    named = path if "*" in path else f"{path[:-1]}[{path[-1]}]"  # the source takes a single file by a pattern alone
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(named)
    return source.select(actor.alias("actor"), item.alias("item"), at.cast("timestamp").alias("at")).dropna()


def keep_up(stream: DataFrame, folder: str, window: str = "1 day", late: str = "2 days") -> StreamingQuery:
    """Starts the upsert of ``stream(actor, item, at)`` into ``folder`` and takes all that is there now, then ends.

    A row that comes more than ``late`` after the newest is dropped; the state of older windows is let go. A later call
    goes on where this one ended.
    """
    baskets = stream.withWatermark("at", late).groupBy("actor", F.window("at", window).alias("window")).agg(F.collect_set("item").alias("items"))

    def upsert(batch: DataFrame, number: int) -> None:
        batch.select("actor", "window.start", F.array_sort("items").alias("files")).write.mode("overwrite").parquet(f"{folder}/baskets/batch={number}")

    return baskets.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(actor, start, files): the baskets as the batches so far left them."""
    every = spark.read.parquet(f"{folder}/baskets")
    last = every.groupBy("actor", "start").agg(F.max_by("files", "batch").alias("files"))
    return last.select("actor", "start", "files")
