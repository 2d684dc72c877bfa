"""Pair tables that arrive as a stream: the same records, each once, counted in windows of their arrival.

The batch engine's sources are bounded; this is an addition for files that keep coming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_arrivals(stream: DataFrame, key: str = "id", at: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """Each key once within ``delay`` of its first arrival; state older than that is forgotten."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, at: str, window: str, *by: str, delay: str = "1 day") -> DataFrame:
    """(start, by, n): rows per window; rows later than ``delay`` behind the newest are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def feed(stream: DataFrame, update: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every batch to ``update`` (a ledger's, for one); ``once`` takes what is there and ends."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: update(df))
    return (w.trigger(availableNow=True) if once else w).start()
