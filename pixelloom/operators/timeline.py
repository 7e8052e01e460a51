"""Timelines: counts by year and month, gap-free series, bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(stamps: DataFrame, ts: str = "ts") -> DataFrame:
    return stamps.filter(F.year(ts) > 1601)


def summary(stamps: DataFrame, ts: str = "ts") -> DataFrame:
    return valid(stamps, ts).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def years(stamps: DataFrame, ts: str = "ts", most: int = 20) -> DataFrame:
    """(year, n, share, opacity): every year from first to last if these are at most `most`, else the occupied ones. Counts are aggregated first; the rest works on a row for each year."""
    counts = valid(stamps, ts).groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    axis = ends.filter(F.col("b") - F.col("a") + 1 <= most).select(F.explode(F.sequence("a", "b")).alias("year"))
    whole = axis.join(counts, "year", "left").union(counts.crossJoin(F.broadcast(ends)).filter(F.col("b") - F.col("a") + 1 > most).select("year", "n"))
    n = F.coalesce("n", F.lit(0))
    share = n / F.max(n).over(Window.partitionBy())
    return whole.select("year", n.cast("long").alias("n"), share.alias("share"), F.when(n == 0, F.lit(0.0)).otherwise(0.06 + 0.44 * share).alias("opacity"))


def months_of_year(stamps: DataFrame, year: int, ts: str = "ts") -> DataFrame:
    """(month, n) of all twelve months."""
    counts = valid(stamps, ts).filter(F.year(ts) == year).groupBy(F.month(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return stamps.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month")).join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def month_band(stamps: DataFrame, ts: str = "ts", most: int = 240, base: float = 2.0, height: float = 20.0, crowded: int = 5) -> DataFrame:
    """(month, n, height, year_start, label) from the first to the last month; empty for one month or more than `most`. Heights follow the logarithm of the counts.

    Years label their January and the first month; the first label is left out if another follows within the next `crowded` - 1 months.
    """
    counts = valid(stamps, ts).groupBy(F.trunc(ts, "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("month").alias("a"), F.max("month").alias("b"), F.max("n").alias("top"))
    span = F.months_between("b", "a") + 1
    axis = ends.filter((span > 1) & (span <= most)).select("a", "top", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    n = F.coalesce("n", F.lit(0))
    tall = F.when(n == 0, F.lit(base)).otherwise(base + (height - base) * F.log(1.0 + n) / F.log(1.0 + F.col("top")))
    band = axis.join(counts, "month", "left")
    start = (F.month("month") == 1) | (F.col("month") == F.col("a"))
    ahead = Window.orderBy("month").rowsBetween(1, crowded - 1)  # over `most` months at most
    near = (F.col("month") == F.col("a")) & F.coalesce(F.max(start).over(ahead), F.lit(False))
    return band.select("month", n.cast("long").alias("n"), tall.alias("height"), start.alias("year_start"), F.when(start & ~near, F.year("month").cast("string")).alias("label"))
