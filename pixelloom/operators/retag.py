"""Tagging again from stored vectors: only the partitions whose tags are of an older set of labels are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "labels_version"


def save_tagged(index: DataFrame, path: str, version: int, folder: str = "folder") -> None:
    """Writes an index, partitioned by folder, whose rows carry the version of the labels they were tagged with; folders of the path that the index has no rows of stay as they are."""
    index.withColumn(VERSION, F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)


def stale_folders(spark: SparkSession, path: str, version: int, folder: str = "folder") -> DataFrame:
    """(folder) with rows tagged by older labels, or never."""
    return spark.read.parquet(path).filter(F.coalesce(F.col(VERSION) < version, F.lit(True))).select(folder).distinct()


def retag(spark: SparkSession, path: str, tagged: Callable[[DataFrame], DataFrame], version: int, folder: str = "folder") -> int:
    """Tags all rows of stale folders anew, out of their stored columns and without their files, and writes these folders only; how many they were.

    tagged(rows) gives the rows with new tags and all their columns. The new rows are written to the shared folder before their partitions are replaced, so the plan never reads
    what it overwrites; a run that breaks off leaves folders stale, which the next run takes up.
    """
    from ..sources.scratch import stored

    stale = stored(stale_folders(spark, path, version, folder), "retag-folders")
    n = stale.count()
    if n:
        rows = spark.read.parquet(path).join(stale.select(F.col(folder).alias("_f")), F.col(folder).eqNullSafe(F.col("_f")), "left_semi").drop(VERSION)
        save_tagged(stored(tagged(rows), "retag-rows"), path, version, folder)
    return n
