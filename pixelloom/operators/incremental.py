"""Incremental refresh of a fingerprint table keyed by (path, size, mtime)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Scanned rows without an index row of the same path, size and time."""
    known = index.select(F.lower("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_t"))
    return scan.join(known, (F.lower(scan["path"]) == F.col("_p")) & (scan["size"] == F.col("_s")) & (scan["mtime"] == F.col("_t")), "left_anti")


def surviving(index: DataFrame, scan: DataFrame) -> DataFrame:
    """Index rows whose file is there, or whose whole folder is missing from the scan (a drive that is not mounted loses nothing)."""
    files = scan.select(F.lower("path").alias("_p")).distinct().withColumn("_there", F.lit(True))
    folders = scan.select(F.lower("folder").alias("_f")).distinct().withColumn("_scanned", F.lit(True))
    out = index.join(files, F.lower(index["path"]) == F.col("_p"), "left").join(folders, F.lower(index["folder"]) == F.col("_f"), "left")
    return out.filter(F.col("_there").isNotNull() | F.col("_scanned").isNull()).select(*index.columns)


def refreshed(scan: DataFrame, index: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index after a scan: surviving rows that did not change, and changed rows described anew. Only the delta is decoded."""
    delta = changed(scan, index)
    kept = surviving(index, scan).join(delta.select(F.lower("path").alias("_d")), F.lower(index["path"]) == F.col("_d"), "left_anti")
    return kept.unionByName(describe(delta))


def own_rows(index: DataFrame, root: str) -> DataFrame:
    """Rows that lie below the index file's folder; foreign rows are dropped."""
    return index.filter(F.startswith(F.lower("path"), F.lit(root.rstrip("/").lower() + "/")))


def stale_texts(scan: DataFrame, cache: DataFrame, slanted: bool = False, full_stage: int = 4) -> DataFrame:
    """Scanned rows whose cached text is missing or of another size or time, or was read before slanted lines were, where those are wanted."""
    fresh = cache.filter(F.coalesce(F.col("slant_stage") >= full_stage, F.lit(False))) if slanted else cache
    return changed(scan, fresh)
