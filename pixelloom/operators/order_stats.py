"""Positions and order statistics of whole tables without a window over all rows: sorted ranges and the offsets of the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in the given order, which should have no ties.

    Rows are dealt to ranges and numbered inside their range; a range starts after the rows of those before it.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    keyed = rows.select("*", *(F.col(o).alias(k) if isinstance(o, str) else o.alias(k) for o, k in zip(order, keys, strict=True)))
    ranged = stored(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "numbered-ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside", *keys)


def cumulated(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, value, n, before, total, next): the distinct values of each group.

    n rows have the value, `before` rows a smaller one, `total` rows belong to the group; next is the next greater value,
    null for the greatest. Null values and rows with a null group are left out. Equal values are counted before anything is
    sorted, and a large group spreads over many ranges.
    """
    known = rows.dropna(subset=[value, *groups])
    counts = known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange(*groups, value).withColumn("_range", F.spark_partition_id()), "cumulated-ranges")
    parts = ranged.groupBy(*groups, "_range").agg(F.sum("n").alias("_n"), F.min(value).alias("_first"))
    over = Window.partitionBy(*groups)  # over the ranges of a group, not its rows
    edges = parts.select(*groups, "_range", (F.sum("_n").over(over.orderBy("_range")) - F.col("_n")).alias("_start"), F.sum("_n").over(over).alias("total"), F.lead("_first").over(over.orderBy("_range")).alias("_after"))
    inside = Window.partitionBy(*groups, "_range").orderBy(value)
    local = ranged.withColumn("_inside", F.sum("n").over(inside) - F.col("n")).withColumn("_next", F.lead(value).over(inside))
    return local.join(edges, [*groups, "_range"]).select(*groups, value, "n", (F.col("_start") + F.col("_inside")).alias("before"), "total", F.coalesce("_next", "_after").alias("next"))


def holds(position: Column) -> Column:
    """Whether a row of cumulated() holds the 0-based position."""
    return (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
