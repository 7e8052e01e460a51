"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, crc_of, hashed_sample, hashed_words, mixed, powers

BITS = 18
#: At most so many labelled rows are learnt from (a documented bound), in so many parallel parts.
TRAIN_ROWS, PARTS, EPOCHS = 12_000, 4, 3
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.05, 0.0
#: Slot beyond the weights in which every part counts itself.
PART_SLOT = (1 << BITS) + 1

# Kinds of bytes for word shapes: upper case, lower case and beyond ASCII, digits; others stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48
_VALUE = mixed(np.arange(5001, 5257, dtype=np.uint64))
_BASE = 0xC2B2AE3D27D4EB4F | 1
_MULT = mixed(np.arange(301, 333, dtype=np.uint64))


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's run-length-free sequence of byte kinds: 'Aa', 'A!', 'a%'."""
    kind = _KIND[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    at = np.flatnonzero(keep)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    sums = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[kind[at]] * powers(_BASE, len(at))[: len(at)], out=sums[1:])
    back = powers(pow(_BASE, -1, 1 << 64), len(at) + 1)
    return mixed((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def features(data: np.ndarray, offsets: np.ndarray):
    """(document, slot, value) of a block: 1- and 2-grams of words, 1- to 3-grams of word shapes; log counts, unit length for each text."""
    doc, h, start, end = hashed_words(data, offsets)
    if not len(doc):
        return doc, doc, np.zeros(0, np.float32)
    s = _shapes(data, start, end)
    docs, keys = [], []
    for j, (x, n) in enumerate(((h, 1), (h, 2), (s, 1), (s, 2), (s, 3))):
        last = len(x) - n + 1
        if last <= 0:
            continue
        v = np.full(last, j + 1, dtype=np.uint64)
        for i in range(n):
            v += x[i : i + last] * _MULT[5 * j + i]
        same = doc[:last] == doc[n - 1 :]
        docs.append(doc[:last][same])
        keys.append(mixed(v)[same] >> np.uint64(64 - BITS))
    key = (np.concatenate(docs).astype(np.int64) << BITS) | np.concatenate(keys).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    doc, slot = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(offsets) - 1))
    return doc, slot, (value / norm[doc]).astype(np.float32)


def _train(table: pa.Table) -> pa.Table:
    """Weights of one part: FTRL-proximal over its rows in a fixed order, several times."""
    table = table.sort_by([("order", "ascending")]).combine_chunks()
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    label = table.column("label").to_numpy()
    examples = []
    for first, offsets, data in blocks(table.column("text")):
        doc, slot, value = features(data, offsets)
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        examples += [(np.append(slot[a:b], 1 << BITS), np.append(value[a:b], np.float32(1)), label[first + i]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for slot, value, y in examples:
            w = weights(slot)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - y) * value
            z[slot] += g - (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / ALPHA * w
            n[slot] += g * g
    w = weights(np.arange(len(z)))
    at = np.flatnonzero(w)
    return pa.table({"slot": pa.array(np.append(at, PART_SLOT)), "w": pa.array(np.append(w[at], 1.0))})


def train_classifier(labelled: DataFrame, text: str = "text", label: str = "label", order: Column | None = None, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of all slots and, last, the bias, from at most `rows` rows of (text, label 0 or 1).

    Rows are dealt to parts by their order hash, each part runs FTRL on its own and the weights are
    averaged over the parts that have rows, so the result does not depend on the cluster. Rows without a label
    are left out, null texts count as empty and teach the bias alone; with no rows all weights are 0.
    """
    order = F.xxhash64(text) if order is None else order
    rows_df = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"), order.alias("order")).orderBy("order").limit(rows)
    parts = rows_df.withColumn("part", F.pmod(F.xxhash64("order"), F.lit(PARTS))).groupBy("part").applyInArrow(_train, "slot long, w double")
    found = parts.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()  # at most 2**18 + 2 rows
    out = np.zeros((1 << BITS) + 2)
    out[found["slot"].to_numpy(np.int64)] = found["w"].to_numpy()
    return (out[:-1] / max(out[PART_SLOT], 1)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key and score in 0..1, a sparse dot product over the whole text; a null or empty text has the bias alone.

    Rows are scored one by one, repeated ones alike; other columns are not looked at. A text is scored in one task, at some 60 bytes of memory a byte.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # 1 MB

    def run(batches):
        w = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, offsets, data in blocks(batch.column(1)):
                doc, slot, value = features(data, offsets)
                dot = np.bincount(doc, w[slot] * value, minlength=len(offsets) - 1) + w[-1]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(offsets) - 1), pa.array(1 / (1 + np.exp(-dot)))], names=[key, "score"])

    slim = docs.select(key, F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, score double")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = crc_of(F.col("doc_id")) % 3 == 1
    chosen = hashed_sample(labels.filter(~held & F.col("quality").isNotNull()), "doc_id", TRAIN_ROWS)
    sample = docs.join(F.broadcast(chosen), "doc_id")  # TRAIN_ROWS rows at most are broadcast
    weights = train_classifier(sample, label="quality", order=F.xxhash64("doc_id"))
    out = score(docs, weights)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
