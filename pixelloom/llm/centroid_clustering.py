"""Centroid clustering in whole numbers, with partial-distance search over the dimensions of highest variance first."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components beyond this bound count as the bound, so that no squared distance overflows.
BOUND = 1 << 27
#: Dimensions that are summed up between two looks at the best distance so far.
STEP = 8


def nearest(cells: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each row (ties: the smaller number), and how many differences were squared.

    Squared differences are summed over the dimensions in the given order; a row leaves a centroid as soon as its sum is
    strictly above its best distance so far. Rows that stay have all dimensions summed, so distances are exact.
    """
    cells, centroids = np.ascontiguousarray(cells[:, order]), centroids[:, order]
    best, which, work = np.full(len(cells), np.iinfo(np.int64).max), np.zeros(len(cells), np.int64), 0
    for k, c in enumerate(centroids):
        row, total = np.arange(len(cells)), np.zeros(len(cells), np.int64)
        for a in range(0, len(order), step):
            apart = cells[row, a : a + step] - c[a : a + step]
            total += (apart * apart).sum(axis=1)
            work += apart.size
            stay = total <= best[row]
            if not stay.all():
                row, total = row[stay], total[stay]
            if not len(row):
                break
        less = total < best[row]
        best[row[less]], which[row[less]] = total[less], k
    return which, best, work


def quantised(vec: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """Components as whole numbers floor(scale * x); null for a vector of another length or with a null, infinite or undefined component."""
    good = (F.size(vec) == dimensions) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cell = lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(x.cast("double") * scale))).cast("int")
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vec, cell))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _spread(dimensions: int):
    """(dim, n, total, squares) of a partition's cells."""

    def run(batches):
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.full(dimensions, float(n))), pa.array(total), pa.array(squares)], names=["dim", "n", "total", "squares"])

    return run


def _sums(shared, dimensions: int):
    """(cluster, dim, total): the sums of a partition's vectors by their nearest centroid; dim -1 has their number."""

    def run(batches):
        centroids, order = shared.value
        found = np.zeros((len(centroids), dimensions + 1), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            which, _, _ = nearest(x, centroids, order)
            rank = np.argsort(which, kind="stable")
            have, first, count = np.unique(which[rank], return_index=True, return_counts=True)
            if len(have):
                found[have, 1:] += np.add.reduceat(x[rank], first, axis=0).astype(object)
                found[have, 0] += count.astype(object)
        k, dim = np.divmod(np.arange(found.size), dimensions + 1)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array((dim - 1).astype(np.int32)), pa.array([Decimal(v) for v in found.ravel()], pa.decimal128(38, 0))], names=["cluster", "dim", "total"])

    return run


def _assigned(shared, dimensions: int):
    def run(batches):
        centroids, order = shared.value
        for batch in batches:
            which, best, _ = nearest(_matrix(batch.column(1), dimensions), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return run


def cluster(table: DataFrame, key: str = "vec_id", vec: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that has `dimensions` finite components.

    Components become floor(scale * x), kept within 2**27 either way. The first centroids are the vectors with the least SHA-256 of
    "seed:key" (a null key reads as empty; ties: by key, then by components), fewer if there are fewer vectors. A round assigns every vector to its nearest
    centroid (ties: the smaller number) and moves every centroid that has vectors to the floor of their mean; then vectors are assigned once more. Sums are
    exact, whatever the number of vectors, so the result does not depend on how the rows are dealt.

    Cells are written once and read by each pass. What is shuffled or kept is a row for each cluster and dimension, so one very common
    vector or cluster makes no task larger. Repeated rows are clustered one by one; other vectors have no row; other columns
    are not looked at; an empty table gives an empty result.
    """
    spark = table.sparkSession
    cells = stored(table.select(F.col(key).alias("id"), quantised(F.col(vec), dimensions, scale).alias("cells")).filter("cells is not null"), "cluster-cells")
    kind = cells.schema["id"].dataType.simpleString()
    order_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = cells.orderBy(order_hash, "id", "cells").limit(clusters).collect()  # as many rows as clusters
    centroids = np.array([r["cells"] for r in first], dtype=np.int64).reshape(-1, dimensions)
    if not len(first):
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    spread = cells.select("cells").mapInArrow(_spread(dimensions), "dim int, n double, total double, squares double").groupBy("dim").agg(F.sum("squares") - F.sum("total") * F.sum("total") / F.sum("n"))
    order = np.array([r[0] for r in sorted(spread.collect(), key=lambda r: (-r[1], r[0]))])  # a row for each dimension
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centroids, order))
        sums = cells.select("cells").mapInArrow(_sums(shared, dimensions), "cluster int, dim int, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("total").alias("total"))
        found = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.collect()}  # a row for each cluster and dimension
        centroids = np.array([[found[k, i] // found[k, -1] for i in range(dimensions)] if found[k, -1] else old for k, old in enumerate(centroids.tolist())], dtype=np.int64)
    shared = spark.sparkContext.broadcast((centroids, order))
    out = stored(cells.mapInArrow(_assigned(shared, dimensions), f"id {kind}, cluster int, distance long"), "cluster-assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each cluster
    named = [(k, v, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, v in inertia.items()]
    rows = out.join(F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")), "cluster")
    return rows.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _assign(k: str) -> str:
    return f"""SELECT rid, vec_id, c, (m).k AS k, (m).s AS s FROM (SELECT rid, any_value(vec_id) AS vec_id, any_value(c) AS c, min({{'s': s, 'k': k}}) AS m
  FROM (SELECT rid, vec_id, v.c, m.k, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.c[i] - m.c[i]) * (v.c[i] - m.c[i])))::BIGINT AS s FROM v, {k} m) GROUP BY rid)"""


def _moved(k: str, a: str) -> str:
    return f"""SELECT o.k, coalesce(n.c, o.c) AS c FROM {k} o LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT k, i, sum(c[i])::BIGINT AS s, count(*) AS n FROM {a}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY k, i) GROUP BY k) n ON n.k = o.k"""


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS c
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSIONS}
), k0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), vec_id NULLS FIRST, c) - 1 AS k, c FROM v QUALIFY k < {CLUSTERS}
), {''.join(f'a{i} AS ({_assign(f"k{i}")}), k{i + 1} AS ({_moved(f"k{i}", f"a{i}")}), ' for i in range(ROUNDS))}a AS ({_assign(f'k{ROUNDS}')})
SELECT vec_id, k::INTEGER AS cluster, s AS distance, (sum(s) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.c, ',')) AS centroid_sha256 FROM a JOIN k{ROUNDS} m USING (k)
"""
