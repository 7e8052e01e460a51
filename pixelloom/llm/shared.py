"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import released, shared_dir, sized, stored  # noqa: F401

#: White space that separates words: blank and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of maximal runs without white space; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, those with the least hash of the key (ties: least key): the same on every run.

    Counting first lets all but about twice as many go before the limit, so that a partition sends few.
    """
    n = df.count()
    order = F.xxhash64(key)
    if n > 4 * rows:
        df = df.filter(F.pmod(order, F.lit(1 << 40)) < int((1 << 40) * (2 * rows / n)))
    return df.orderBy(F.pmod(order, F.lit(1 << 40)), key).limit(rows)


def most_frequent(counts: DataFrame, n: str, rows: int) -> DataFrame:
    """The rows with the highest counts, at most `rows`: all of whole classes of counts (an eighth of a power of two wide), so that nothing is sorted and what is returned has a fixed bound."""
    kind = F.floor(F.log2(n) * 8).cast("int")
    sizes = sorted(((r["k"], r["c"]) for r in counts.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)  # a row for each class
    least, total = None, 0
    for k, c in sizes:
        total += c
        if total > rows:
            break
        least = k
    return counts.filter(kind >= least) if least is not None else counts.limit(0)


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


# Arrow batches as byte buffers, for the operators that hash words in NumPy.

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept in the worker for the longest n so far."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        found = np.full(m, base, dtype=np.uint64)
        found[0] = 1
        found = _powers[base] = np.cumprod(found, dtype=np.uint64)
    return found


def blocks(column, limit: int = 1 << 18):
    """Yields (first row, offsets, bytes) of runs of rows of about limit bytes; a longer text is a run of its own. Null counts as empty."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null(b"" if column.type == "binary" else "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        yield first, offs[first : last + 1] - offs[first], data[offs[first] : offs[last]]
        first = last


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, is_word: np.ndarray = _IS_WORD):
    """(document index, 64-bit hash, start, end) of every word of a block; is_word tells the bytes that words are made of."""
    if lower:
        data = _LOW[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data))[: len(data)], out=sums[1:])
    back = powers(pow(_BASE, -1, 1 << 64), len(data))
    return doc, mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)), start, end
