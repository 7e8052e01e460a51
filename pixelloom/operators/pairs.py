"""Exact pair joins on vectors and hashes.

Vectors that cluster are dealt to the cells of pivots, and a row meets only rows of its own cell and of cells that the triangle inequality leaves possible. Where that
leaves most cells possible, rows are packed into blocks, and every two blocks meet in a task, strip by strip, so that its memory has a fixed bound; only pairs that pass
the threshold leave it. Hamming joins with a small distance use bands instead. Where only groups matter, equal rows stand for each other, and a pair of blocks gives links
that hold its groups together, not all pairs: see cosine_links() and hamming_links().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hamming
from ..sources.scratch import stored

BLOCK_ROWS = 1000
#: At most so many pivots, one for each BLOCK_ROWS rows before that; every task holds them.
PIVOTS = 4096
#: Cells are used where a pivot leaves at most this share of the others possible.
SPARSE = 0.25
#: A packed block has at most so many times BLOCK_ROWS rows, and packed blocks are dealt to at most so many partitions a side.
PACKED, SIDES = 8, 100
#: Values of a strip of a product, and rows of a batch of copies.
STRIP, COPIES = 1_000_000, 20_000


def _product(least: float):
    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        s = np.stack(x["va"].to_numpy()) @ np.stack(y["vb"].to_numpy()).T
        p, q = np.nonzero(s >= least)
        a, b = x["ka"].to_numpy()[p], y["kb"].to_numpy()[q]
        keep = a < b if x["i"].iloc[0] == x["j"].iloc[0] else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": s[p, q][keep]})

    return product


def _placed(pivots: np.ndarray, reach: float):
    """(cell, own, k, v): each row in the cell of its nearest pivot, and a copy in each cell of a smaller number that may hold a partner."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            apart = np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * v @ pivots.T, 0))
            own = apart.argmin(axis=1)
            near = apart - apart[np.arange(len(v)), own][:, None] <= reach
            near &= np.arange(len(pivots)) < own[:, None]
            row, cell = np.nonzero(near)
            row, cell = np.concatenate([np.arange(len(v)), row]), np.concatenate([own, cell])
            owns = np.arange(len(row)) < len(v)
            for lo in range(0, len(row), COPIES):
                part = slice(lo, lo + COPIES)
                at = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([pa.array(cell[part].astype(np.int32)), pa.array(owns[part]), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "own", "k", "v"])

    return run


def _near_vectors(least: float):
    """Places (p, q) and scores of the pairs of a strip with a block."""

    def near(x: np.ndarray, y: np.ndarray):
        s = x.astype(np.float64, copy=False) @ y.astype(np.float64, copy=False).T
        p, q = np.nonzero(s >= least)
        return p, q, s[p, q]

    return near


def _near_hashes(most: int):
    def near(x: np.ndarray, y: np.ndarray):
        d = np.bitwise_count(x.astype(np.int64, copy=False).view(np.uint64) ^ y.astype(np.int64, copy=False).view(np.uint64).T)
        p, q = np.nonzero(d <= most)
        return p, q, d[p, q].astype(np.int32)

    return near


def _merged(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels in which p and q have the same root; each label is that of its root, the least place of its group."""
    while len(p):
        a, b = label[p], label[q]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _met(near, links: bool):
    """Pairs of two packed blocks, or links that hold their groups together."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, ks, vs, j, ls, ws = (batch.column(c)[r] for c in range(6))
                ks, ls = ks.values.to_numpy(zero_copy_only=False), ls.values.to_numpy(zero_copy_only=False)
                x, y = (v.values.to_numpy(zero_copy_only=False).reshape(len(k), len(v.values) // len(k)) for v, k in ((vs, ks), (ws, ls)))
                same = i.as_py() == j.as_py()
                label = np.arange(len(ks) + len(ls))
                rows = max(1, STRIP // len(ls))
                for lo in range(0, len(ks), rows):
                    p, q, value = near(x[lo : lo + rows], y)
                    p = p + lo
                    if same:
                        once = ks[p] < ls[q]
                        p, q, value = p[once], q[once], value[once]
                    if links:
                        label = _merged(label, p, q if same else q + len(ks))
                    elif len(p):
                        a, b = ks[p], ls[q]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(value)], names=["a", "b", "value"])
                if links:
                    keys = np.concatenate([ks, ls])
                    at = np.flatnonzero(label != np.arange(len(keys)))
                    a, b = keys[label[at]], keys[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _by_blocks(rows: DataFrame, n: int, values, near, kind: str, links: bool) -> DataFrame:
    """(a, b, value), or (a, b) of links, of n rows (k, v) in packed blocks. Each row is shuffled twice; a task reads two blocks, or a few."""
    size = max(BLOCK_ROWS, min(PACKED * BLOCK_ROWS, n // 8))
    blocks = max(1, -(-n // size))
    key = rows.schema["k"].dataType.simpleString()
    packed = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("i")).agg(F.collect_list("k").alias("ks"), values(F.collect_list("v")).alias("vs"))
    left = stored(packed, "pair-blocks").repartition(min(blocks, SIDES), "i")
    right = left.select(F.col("i").alias("j"), F.col("ks").alias("ls"), F.col("vs").alias("ws"))
    both = left.join(right.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))
    out = both.mapInArrow(_met(near, links), f"a {key}, b {key}" + ("" if links else f", value {kind}"))
    return stored(out, "block-links") if links else out  # links are read more than once


def cosine_pairs(table: DataFrame, least: float, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(a, b, score) with a < b and dot product >= least; rows without a vector or key pair with nothing."""
    return _cosine(table.select(F.col(key).alias("k"), F.col(vec).alias("v")), least, False)


def _cosine(table: DataFrame, least: float, links: bool) -> DataFrame:
    """Pairs, or links among them, of rows (k, v).

    Rows x, y with x.y >= least are at most sqrt(2 (R^2 - least)) apart, R being the largest norm. So a row of one cell can only have a partner of
    another cell if the other's pivot is at most twice that farther from it than its own; there it gets a copy. Pairs of two cells are found in the cell of the
    smaller number. Nothing is left out: where vectors lie everywhere alike, as the pivots tell, this is a join of all blocks.
    """
    spark = table.sparkSession
    known = table.filter("k is not null and v is not null")
    rows = known.withColumn("v", F.col("v").cast("array<double>"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).first()
    pivots = rows.orderBy(F.xxhash64("k"), "k").limit(min(PIVOTS, max(1, -(-whole["n"] // BLOCK_ROWS)))).select("v").collect()
    kind = rows.schema["k"].dataType.simpleString()
    if not pivots:
        return spark.createDataFrame([], "a long, b long, score double")
    reach = 2 * np.sqrt(max(2 * (whole["most"] - least), 0.0)) + 1e-9
    v = np.array([p["v"] for p in pivots], dtype=float)
    apart = np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * v @ v.T, 0))
    if len(v) == 1 or (apart <= reach).mean() > SPARSE:
        single = known.schema["v"].dataType.simpleString() == "array<float>"
        out = _by_blocks(known if single else rows, whole["n"], F.flatten, _near_vectors(least), "double", links)
        return out if links else out.withColumnRenamed("value", "score")
    placed = rows.mapInArrow(_placed(v, float(reach)), f"cell int, own boolean, k {kind}, v array<double>")
    sides = lambda own: F.ceil(F.count_if(F.col("own") if own else ~F.col("own")) / BLOCK_ROWS).cast("int")
    cells = F.broadcast(stored(placed.groupBy("cell").agg(sides(True).alias("s"), sides(False).alias("c")), "pair-cells"))  # a row for each pivot at most
    side = F.when(F.col("own"), F.pmod(F.xxhash64("k"), F.col("s"))).otherwise(F.col("s") + F.pmod(F.xxhash64("k"), F.col("c"))).cast("int")
    dealt = placed.join(cells, "cell").filter("s > 0").withColumn("side", side)
    last = F.col("s") + F.col("c") - 1
    left = dealt.filter("own").select("cell", F.col("k").alias("ka"), F.col("v").alias("va"), F.col("side").alias("i"), F.explode(F.sequence("side", last)).alias("j"))
    upto = F.when(F.col("own"), F.col("side")).otherwise(F.col("s") - 1)
    right = dealt.select(F.col("cell").alias("cell_b"), F.col("k").alias("kb"), F.col("v").alias("vb"), F.explode(F.sequence(F.lit(0), upto)).alias("i_b"), F.col("side").alias("j_b"))
    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell_b", "i_b", "j_b")).applyInPandas(_product(least), "a long, b long, score double")


def _with_equals(rows: DataFrame, value: str, links, joined) -> DataFrame:
    """(a, b): links among the least keys of equal values, and between each key and the least one, where `joined` holds for a value with itself."""
    first = stored(rows.groupBy(value).agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("n")), "equal-rows")
    others = rows.join(first.filter((F.col("n") > 1) & joined(F.col(value))).select(value, "least"), value).filter("k <> least")
    return links(first.select(F.col("least").alias("k"), value)).select("a", "b").union(others.select(F.col("least").alias("a"), F.col("k").alias("b")))


def cosine_links(table: DataFrame, least: float, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(a, b): links that hold the groups of cosine_pairs() together: equal vectors are linked to the one of the least key, which alone is compared with others."""
    rows = table.select(F.col(key).alias("k"), F.col(vec).alias("v")).filter("k is not null and v is not null")
    return _with_equals(rows, "v", lambda r: _cosine(r, least, True), lambda v: F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x) >= least)


def hamming_links(table: DataFrame, most: int, key: str = "vec_id", hash_col: str = "hash") -> DataFrame:
    """(a, b): links that hold the groups of hamming_pairs() together: equal hashes are linked to the one of the least key, which alone is compared with others."""
    rows = table.select(F.col(key).alias("k"), F.col(hash_col).alias("h")).filter("k is not null and h is not null")
    return _with_equals(rows, "h", lambda r: _hamming(r, most, True), lambda h: F.lit(True))


def hamming_pairs(table: DataFrame, most: int, key: str = "vec_id", hash_col: str = "hash") -> DataFrame:
    """(a, b, distance) with a < b and at most `most` differing bits.

    Of most + 1 bands of bits one is equal in any such pair, so pairs meet in an equi-join on a band and
    are then compared whole. With more than 16 bands a band has so few bits that blocks are cheaper.
    """
    return _hamming(table.select(F.col(key).alias("k"), F.col(hash_col).alias("h")).filter("k is not null and h is not null"), most, False)


def _hamming(rows: DataFrame, most: int, links: bool) -> DataFrame:
    """Pairs, or links among them, of rows (k, h)."""
    if most + 1 <= 16:
        edges = [round(i * 64 / (most + 1)) for i in range(most + 2)]
        bands = F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("h", 64 - b), 64 - b + a).alias("bits")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))))
        banded = rows.withColumn("s", F.explode(bands)).select("k", "h", "s.band", "s.bits")
        l, r = (banded.select(F.col("k").alias(k), F.col("h").alias(f"h{k}"), "band", "bits") for k in "ab")
        near = l.join(r, ["band", "bits"]).filter("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb")))
        return near.filter(F.col("distance") <= most).select("a", "b", "distance").distinct()
    out = _by_blocks(rows.withColumnRenamed("h", "v"), rows.count(), lambda v: v, _near_hashes(most), "int", links)
    return out if links else out.withColumnRenamed("value", "distance")
