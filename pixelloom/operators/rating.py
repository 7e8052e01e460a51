"""Quality rating against a folder's upper median."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order_stats import cumulated, holds


def medians(table: DataFrame, folder: str, value: str) -> DataFrame:
    """(folder, median, compared): element n div 2 of a folder's sorted positive values, found by counts of equal values; no row without a folder."""
    ranked = cumulated(table.filter(F.col(value) > 0).select(folder, value), value, folder)
    return ranked.filter(holds(F.floor(F.col("total") / 2))).select(folder, F.col(value).alias("median"), F.col("total").alias("compared"))


def verdict(value: Column, median: Column, compared: Column, ratio: float, least: int = 10) -> Column:
    """Null where undefined or too few were compared, else whether the value falls below its share of the median. The share of a whole number is exact: 55 is not below 0.55 of 100."""
    return F.when((value <= 0) | value.isNull() | median.isNull() | (compared < least), F.lit(None).cast("boolean")).otherwise(value < median * F.lit(Decimal(str(ratio))))


def with_floor(judged: Column, value: Column, floor: float) -> Column:
    """Bad below an absolute floor, whatever the folder says."""
    return F.when((value > 0) & (value < floor), F.lit(True)).otherwise(judged)


def rated(table: DataFrame, folder: str, value: str, ratio: float, floor: float | None = None, least: int = 10) -> DataFrame:
    out = table.join(medians(table, folder, value), folder, "left")
    judged = verdict(F.col(value), F.col("median"), F.coalesce("compared", F.lit(0)), ratio, least)
    return out.withColumn("bad", judged if floor is None else with_floor(judged, F.col(value), floor))


def running_medians(table: DataFrame, folder: str, value: str, order: str) -> DataFrame:
    """Adds the upper median of the positive values seen so far in each folder, null before the first; rows without a folder are one folder.

    A folder is looked through in order, so it is one task's work, but it is read in batches, and only its positive
    values stay in memory, as two heaps. Select the needed columns before: all of them go through Arrow.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, low, high = None, [], []
        for batch in batches:
            out = []
            for f, v in zip(batch.column(folder).to_pylist(), batch.column("_value").to_pylist(), strict=True):
                if current != (f,):
                    current, low, high = (f,), [], []
                if v is not None and v > 0:
                    heapq.heappush(high, v)
                    heapq.heappush(low, -heapq.heappop(high))
                    if len(low) > (len(low) + len(high)) // 2:
                        heapq.heappush(high, -heapq.heappop(low))
                out.append(high[0] if high else None)
            names = [n for n in batch.schema.names if n != "_value"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, "running_median"])

    dealt = table.withColumn("_value", F.col(value).cast("double")).repartition(folder).sortWithinPartitions(folder, order)
    return dealt.mapInArrow(seen, T.StructType([*table.schema.fields, T.StructField("running_median", T.DoubleType())]))


def bytes_per_pixel(length: Column, width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), length / width / height).otherwise(F.lit(0.0))
