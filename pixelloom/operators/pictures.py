"""Filters over whole pictures, one row each: (image, width, height, values), the values row by row.

A picture never leaves its row, so nothing is shuffled; pictures of one size in a batch are filtered together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_vectors(table: DataFrame, width: int, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Vectors as pictures of the given width; null vectors and those that do not fill whole rows are left out."""
    v = F.col(values).cast("array<double>")
    return table.select(F.col(key).alias("image"), F.lit(width).alias("width"), F.floor(F.size(v) / width).cast("int").alias("height"), v.alias("values")).filter((F.size("values") > 0) & (F.size("values") % width == 0))


def mapped(pictures: DataFrame, outputs: list[str], f: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(image, width, height, outputs): f turns (pictures, height, width) into one array (pictures, values) for each output. Pictures whose values do not fill their size, or hold a null, are left out."""

    def run(batches):
        for batch in batches:
            w, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height"))
            lists = batch.column("values")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            known = np.append(0, np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False)))
            values, end = flat.to_numpy(zero_copy_only=False), np.cumsum(np.nan_to_num(n).astype(np.int64))
            start = end - np.nan_to_num(n).astype(np.int64)
            good = (w > 0) & (h > 0) & (n == w * h) & (known[end] - known[start] == end - start)
            for size in sorted({*zip(w[good].tolist(), h[good].tolist(), strict=True)}):
                rows = np.flatnonzero(good & (w == size[0]) & (h == size[1]))
                x = values[start[rows][:, None] + np.arange(int(size[0] * size[1]))].astype(np.float64).reshape(len(rows), int(size[1]), int(size[0]))
                arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(y).ravel())) for y in f(x)]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("image", "width", "height")), *arrays], names=["image", "width", "height", *outputs])

    slim = pictures.select("image", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("values").cast("array<double>").alias("values"))
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:3], *(T.StructField(o, T.ArrayType(T.DoubleType())) for o in outputs)]))


def box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the (2 radius + 1)-sided box around each value, clipped at the border."""
    n, h, w = x.shape
    sums = np.zeros((n, h + 1, w + 1))
    np.cumsum(np.cumsum(x, axis=1), axis=2, out=sums[:, 1:, 1:])
    top, low = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    left, right = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    rows = sums[:, low] - sums[:, top]
    return (rows[:, :, right] - rows[:, :, left]) / ((low - top)[:, None] * (right - left))


def gradients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and orientation, within 0..pi, of the inner values' Sobel gradients."""
    sy, sx = x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:], x[:, :, :-2] + 2 * x[:, :, 1:-1] + x[:, :, 2:]
    gx, gy = sy[:, :, 2:] - sy[:, :, :-2], sx[:, 2:] - sx[:, :-2]
    angle = np.arctan2(gy, gx)
    return np.sqrt(gx * gx + gy * gy), np.where(angle < 0, angle + math.pi, angle)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


def high_pass(pictures: DataFrame, radius: int = 6) -> DataFrame:
    """Values less the mean of their box."""
    return mapped(pictures, ["values"], lambda x: [_flat(x - box_mean(x, radius))])


def blurred(pictures: DataFrame) -> DataFrame:
    """Mean of each 3 x 3 box."""
    return mapped(pictures, ["values"], lambda x: [_flat(box_mean(x, 1))])


def sobel(pictures: DataFrame) -> DataFrame:
    """(image, width, height, magnitude, orientation) of the inner values, so width and height less 2 each; pictures below 3 x 3 have empty arrays."""

    def f(x: np.ndarray) -> list[np.ndarray]:
        if min(x.shape[1:]) < 3:
            return [np.zeros((len(x), 0))] * 2
        return [_flat(y) for y in gradients(x)]

    return mapped(pictures, ["magnitude", "orientation"], f)


def shape_descriptors(pictures: DataFrame, bins: int = 36, noise: float = 0.10) -> DataFrame:
    """(image, descriptor): orientation histogram of unit length, each gradient split on two neighbouring bins; gradients up to `noise` of the strongest are left out. Zeros for a flat picture."""

    def f(x: np.ndarray) -> list[np.ndarray]:
        if min(x.shape[1:]) < 3:
            return [np.zeros((len(x), bins))]
        size, angle = (_flat(y) for y in gradients(x))
        row, at = np.nonzero(size > size.max(axis=1, keepdims=True) * noise)
        place = angle[row, at] / (math.pi / bins)
        low, part, w = np.floor(place).astype(np.int64) % bins, place - np.floor(place), size[row, at]
        flat = np.bincount(np.concatenate([row * bins + low, row * bins + (low + 1) % bins]), np.concatenate([w * (1 - part), w * part]), minlength=len(x) * bins)
        hist = flat.reshape(len(x), bins)
        norm = np.sqrt((hist * hist).sum(axis=1, keepdims=True))
        return [np.where(norm > 1e-9, hist / np.maximum(norm, 1e-300), hist)]

    return mapped(pictures, ["descriptor"], f).select("image", "descriptor")


def pixels(pictures: DataFrame, *columns: str, margin: int = 0) -> DataFrame:
    """(image, x, y, columns): a row for each value of a picture, or of its inner part without `margin` values at each border."""
    inner = F.col("width") - 2 * margin
    out = pictures.select("image", inner.alias("_w"), F.posexplode(F.arrays_zip(*columns)).alias("_p", "_v"))
    return out.select("image", (F.col("_p") % F.col("_w") + margin).alias("x"), (F.floor(F.col("_p") / F.col("_w")) + margin).cast("int").alias("y"), *(F.col(f"_v.{c}").alias(c) for c in columns))
