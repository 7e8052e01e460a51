"""Column functions over ARRAY<FLOAT|DOUBLE> vectors. Arithmetic is in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once for a row: inside the lambda of a higher-order function, an expression is made anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ."""
    total = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, negatives as 0."""
    return F.greatest(F.lit(0.0), dot(a, b))


def calibrated_similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 within 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dot(a, b) + 1) / 2))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """Unit vector; null for vectors of norm 1e-9 and below."""
    return once(as_double(v), lambda a: once(norm(a), lambda n: F.when(n > 1e-9, F.transform(a, lambda x: x / n))))


def cyclic_similarity(a: Column, b: Column, shifts: int) -> Column:
    """Best similarity over cyclic shifts of b, at least 0."""
    best = lambda x, twice: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shifts - 1)), lambda s: dot(x, F.slice(twice, s + 1, F.size(x)))))
    return F.greatest(F.lit(0.0), once(as_double(a), lambda x: once(F.concat(as_double(b), as_double(b)), lambda twice: best(x, twice))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_bits(bits: Column) -> Column:
    """LONG from an array of 64 booleans, first element in the lowest bit. Bits are or-ed, so the sign bit does not overflow."""
    placed = F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(placed, F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))


def average_hash(pixels: Column) -> Column:
    """Bit i set where pixel i is at least the mean of all."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)
    return once(as_double(pixels), lambda p: once(mean(p), lambda m: hash_from_bits(F.transform(p, lambda x: x >= m))))


def difference_hash(pixels: Column, width: int) -> Column:
    """Bit set where a pixel is brighter than its right neighbour, over rows of width pixels (width - 1 bits each)."""
    at = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 2), lambda i: i % width != width - 1)
    return once(as_double(pixels), lambda p: hash_from_bits(F.transform(at(p), lambda i: F.get(p, i) > F.get(p, i + 1))))
