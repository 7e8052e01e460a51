"""Structured Streaming forms: new files, debounced changes, running counts for each folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def debounced(changes: DataFrame, gap: str = "400 milliseconds", late: str = "10 seconds", ts: str = "ts", key: str = "path") -> DataFrame:
    """(path, first, last, changes): one row for each burst of changes to a path that is followed by a pause."""
    return changes.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("changes")).select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "changes")


def counts_by_window(events: DataFrame, every: str, late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def index_sink(describe: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: describes a micro-batch into a partition of its own, which a retried batch replaces."""

    def write(batch: DataFrame, epoch: int) -> None:
        describe(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
