"""Calibration of a vector collection: mean and leading components, removed before comparing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, normalised
from .moments import moments


def mean_vector(table: DataFrame, vec: str = "embedding") -> DataFrame:
    long = table.select(F.posexplode(F.col(vec).cast("array<double>")).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x"))
    return long.agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("px")).select(F.transform("px", lambda e: e.x).alias("mean"))


def centred(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """Replaces the vector by its unit-length difference from the collection's mean."""
    both = table.crossJoin(F.broadcast(mean_vector(table, vec)))  # one row
    return both.withColumn(vec, normalised(F.zip_with(as_double(F.col(vec)), F.col("mean"), lambda x, m: x - m))).drop("mean")


def fit(table: DataFrame, components: int, vec: str = "embedding") -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and the first components; None for fewer than three vectors. Spark sums the products of positions, the driver solves a matrix of the vectors' dimension."""
    found = moments(table, F.col(vec), F.lit(0))
    if not found or found[0][0][0] < 3:
        return None
    n, total, products = found[0]
    mean = total / n
    cov = products / n[:, None] - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(cov)
    return mean, vectors[:, ::-1][:, :components].T


def applied(vec: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """Centres, takes the components out and normalises."""
    c = F.zip_with(as_double(vec), F.array(*map(F.lit, map(float, mean))), lambda x, m: x - m)
    for pc in components:
        p = F.array(*map(F.lit, map(float, pc)))
        share = F.aggregate(F.zip_with(c, p, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        c = _without(c, p, share)
    return normalised(c)


def _without(c: Column, p: Column, share: Column) -> Column:
    """c less its share of p. One-element transforms name the vector and the share, so that neither is built twice."""
    pair = F.transform(F.array(F.struct(c.alias("c"), share.alias("s"))), lambda e: F.zip_with(e.c, p, lambda x, y: x - e.s * y))
    return F.element_at(pair, 1)
