"""Sums of vectors and of their outer products, added up inside Arrow batches and merged by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double


def moments(table: DataFrame, vec: Column, side: Column) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """side -> (rows with a position, sums of positions, sums of products of two positions).

    A task gives one row for each pair of positions, so what is shuffled and collected follows the square of the
    dimension, not the rows. Rows without a vector or side are left out, null elements count as 0; a shorter
    vector adds to its own positions only.
    """
    rows = table.select(side.cast("int").alias("side"), as_double(vec).alias("v")).filter("side is not null and v is not null")

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            sides, lists = batch.column(0).to_numpy(), batch.column(1)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            at = np.cumsum(size) - size
            for s, n in {*zip(sides.tolist(), size.tolist(), strict=True)}:
                k = np.flatnonzero((sides == s) & (size == n))
                x = flat[at[k][:, None] + np.arange(n)]
                found = held.setdefault((s, n), [0, np.zeros(n), np.zeros((n, n))])
                found[0] += len(k)
                found[1] += x.sum(axis=0)
                found[2] += x.T @ x
        for (s, n), (count, total, products) in held.items():
            i, j = np.triu_indices(n)
            i, j, value = np.concatenate([np.arange(n), i]), np.concatenate([np.full(n, -1), j]), np.concatenate([total, products[i, j]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), count)), pa.array(value)], names=["side", "i", "j", "n", "value"])

    merged = rows.mapInArrow(run, "side int, i int, j int, n long, value double").groupBy("side", "i", "j").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    side_, i, j, n, value = (c.to_numpy() for c in merged.toArrow().select(["side", "i", "j", "n", "value"]).columns)
    out = {}
    for s in np.unique(side_):
        own = side_ == s
        dim = int(i[own].max()) + 1
        one, two = own & (j < 0), own & (j >= 0)
        count, total, products = np.zeros(dim, np.int64), np.zeros(dim), np.zeros((dim, dim))
        count[i[one]], total[i[one]] = n[one], value[one]
        products[i[two], j[two]] = products[j[two], i[two]] = value[two]
        out[int(s)] = (count, total, products)
    return out
