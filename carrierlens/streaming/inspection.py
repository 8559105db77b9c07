"""Inspection of streams: the same plan a row, whole documents in, reports out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlens.operators.inspect import inspect
from carrierlens.settings import Limits, Policy


def documents(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    """A stream of Parquet documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def reports(stream: DataFrame, text: str = "text", policy: Policy = Policy.BALANCED, limits: Limits | None = None) -> DataFrame:
    """The stream with report columns: stateless, so append mode and any sink do."""
    return inspect(stream, text, policy, limits)


def first_of_each(stream: DataFrame, key: str, time: str, within: str = "1 hour") -> DataFrame:
    """The first row of each key; a late repeat within the watermark is dropped, never allowed."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def actions_by_window(stream: DataFrame, time: str, size: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Counts of actions (or statuses, where held) in tumbling windows."""
    return stream.withWatermark(time, within).groupBy(F.window(time, size), F.coalesce("action", "status").alias("outcome")).count()


def each_batch(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a batch operator (a gate, a replay) on every micro-batch, over what is there now."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_table(stream: DataFrame, name: str, checkpoint: str):
    """Appends the stream to an in-memory table over what is there now (for small checks)."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
