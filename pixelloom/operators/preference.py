"""Preference learning from kept and rejected vectors: centroids, pooled profiles, ridge direction, ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .moments import moments
from .order_stats import numbered


def side_sums(table: DataFrame, *keys: str, bad: str = "bad", vec: str = "embedding") -> DataFrame:
    """(keys, p, n_good, n_bad, sum_good, sum_bad): mergeable sums of each position."""
    long = table.select(*keys, F.col(bad).cast("boolean").alias("_bad"), F.posexplode(F.col(vec).cast("array<double>")).alias("p", "x"))
    return long.groupBy(*keys, "p").agg(
        F.count_if(~F.col("_bad")).alias("n_good"), F.count_if("_bad").alias("n_bad"),
        F.coalesce(F.sum(F.when(~F.col("_bad"), F.col("x"))), F.lit(0.0)).alias("sum_good"), F.coalesce(F.sum(F.when(F.col("_bad"), F.col("x"))), F.lit(0.0)).alias("sum_bad"),
    )


def centroid_direction(sums: DataFrame, least: int = 5) -> DataFrame:
    """(p, d): mean of the rejected less mean of the kept; empty if a side has fewer than `least`."""
    return sums.filter((F.col("n_good") >= least) & (F.col("n_bad") >= least)).select("p", (F.col("sum_bad") / F.col("n_bad") - F.col("sum_good") / F.col("n_good")).alias("d"))


def pooled_direction(sums: DataFrame, without, folder: str = "folder", least: int = 5) -> DataFrame:
    """Direction from the summed sums of all folders but one; a folder counts if both of its sides have `least`."""
    kept = sums.filter((F.col(folder) != F.lit(without)) & (F.col("n_good") >= least) & (F.col("n_bad") >= least))
    return centroid_direction(kept.groupBy("p").agg(*(F.sum(c).alias(c) for c in ("n_good", "n_bad", "sum_good", "sum_bad"))), least)


def as_vector(direction: DataFrame, value: str = "d", unit: bool = True) -> DataFrame:
    """One row with `vector`, of unit length if asked."""
    one = direction.agg(F.array_sort(F.collect_list(F.struct("p", value))).alias("px"), F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    return one.filter(F.size("px") > 0).select(F.transform("px", lambda e: e[value] / F.col("norm") if unit else e[value]).alias("vector"))


def ridge_direction(table: DataFrame, strength: float = 0.003, bad: str = "bad", vec: str = "embedding", least: int = 5) -> np.ndarray | None:
    """(C + strength I)^-1 d for the unit centroid difference d; C is the sum over both sides of the mean outer product.

    Sums and outer products of both sides come from one pass over the rows; the driver solves a system of the
    vectors' dimension. None for fewer than `least` vectors on a side, or for equal centroids.
    """
    found = moments(table, F.col(vec), F.col(bad).cast("boolean"))
    if len(found) < 2 or any(n.min() < least for n, _, _ in found.values()) or len(found[0][0]) != len(found[1][0]):
        return None
    d = found[1][1] / found[1][0] - found[0][1] / found[0][0]
    norm = float(np.linalg.norm(d))
    if norm <= 0:
        return None
    d, c = d / norm, sum(products / n[:, None] for n, _, products in found.values())
    try:
        low = np.linalg.cholesky(c + strength * np.eye(len(d)))
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(low.T, np.linalg.solve(low, d))


def ranked(table: DataFrame, vector: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, rating, position): dot with the direction scaled to 0..1 over all rows (0.5 where they hardly differ), highest first."""
    scored = table.crossJoin(F.broadcast(vector.limit(1))).select(key, dot(F.col(vec), F.col("vector")).alias("s"))
    ends = scored.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))  # one row
    out = scored.crossJoin(F.broadcast(ends)).select(key, F.when(F.col("hi") - F.col("lo") <= 1e-9, F.lit(0.5)).otherwise((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("rating"))
    return out


def blended(own: np.ndarray | None, pooled: np.ndarray | None, n_small: int) -> np.ndarray | None:
    """Own direction with weight n / (n + 5), n being the smaller side; the other alone where one is missing."""
    if own is None or pooled is None:
        return own if pooled is None else pooled
    a = n_small / (n_small + 5)
    return a * own / np.linalg.norm(own) + (1 - a) * pooled / np.linalg.norm(pooled)


def folder_vector(table: DataFrame, sums: DataFrame, own, folder: str = "folder", vec: str = "embedding", least: int = 5) -> np.ndarray | None:
    """The direction that ranks a folder: its own ridge direction, or its centroid difference where that has none, blended with the pooled direction of all other folders.

    table: (bad, embedding) of the folder, sums: the sums of all folders. None if neither side has a direction.
    """
    first = lambda df: (lambda r: np.array(r["vector"]) if r else None)(as_vector(df).first())
    mine = sums.filter(F.col(folder) == F.lit(own))
    direction = ridge_direction(table, vec=vec, least=least)
    direction = first(centroid_direction(mine, least)) if direction is None else direction
    small = mine.agg(F.min(F.least("n_good", "n_bad"))).first()[0]
    return blended(direction, first(pooled_direction(sums, own, folder, least)), int(small or 0))


def positions(rated: DataFrame, key: str = "vec_id") -> DataFrame:
    """Adds the rank, from 1, by rating and then by key."""
    return numbered(rated, -F.col("rating"), key).withColumn("position", F.col("position") + 1)
