"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary text, compared by their length-normalised log-likelihoods."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, crc_of, hashed_sample, hashed_words, mixed, stored

#: At most so many labelled rows of each class are learnt from (a documented bound); one in CALIBRATION of them sets the scale of the score.
CLASS_ROWS, CALIBRATION = 6_000, 4
DISCOUNT = 0.75
#: An entry of a class stays only if both classes together have seen it after so many different contexts, and if the classes
#: differ in it by this factor; all others take the shared backoff.
LEAST, RATIO = 7, 10.0
#: Log-likelihood ratios per word are compressed beyond this size, and the slope of the score is held back by this much.
UNIT, RIDGE = 0.01, 0.005

BEGIN = int(mixed(np.array([81], dtype=np.uint64))[0])
_PAIR, _TRIPLE = (np.uint64(int(x) | 1) for x in mixed(np.array([82, 83], dtype=np.uint64)))
# Words are letters, digits and all beyond ASCII.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


class Model(NamedTuple):
    """Probabilities of both classes (ordinary, toxic) as logarithms. words and pairs: hashes in order; rest: of a word that has no entry;
    back: weight of the words below a context, for contexts with entries."""

    words: np.ndarray
    word_log: np.ndarray
    rest: np.ndarray
    pairs: np.ndarray
    pair_log: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * _PAIR + word)


def tokens(column: pa.Array):
    """(first row, rows, document, word, word before, word before that) for each block of texts, in lower case."""
    low = pc.utf8_lower(column)
    for first, offsets, data in blocks(low):
        doc, word, _, _ = hashed_words(data, offsets, lower=False, is_word=_LETTER)
        new = np.ones(len(word), dtype=bool)
        new[1:] = doc[1:] != doc[:-1]
        before, further = np.full(len(word), BEGIN, np.uint64), np.full(len(word), BEGIN, np.uint64)
        before[1:] = np.where(new[1:], np.uint64(BEGIN), word[:-1])
        further[1:] = np.where(new[1:], np.uint64(BEGIN), before[:-1])
        yield first, len(offsets) - 1, doc, word, before, further


def _contexts_pass(batches):
    """(label, context, word, further): what stands before each word, once for each block."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for first, _, doc, word, before, further in tokens(batch.column(0)):
            of = label[first + doc].astype(np.int32)
            _, one = np.unique(mixed(_pair(before, word) * _TRIPLE + further) ^ mixed(of.astype(np.uint64) + np.uint64(1)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(of[one]), *(pa.array(x[one].view(np.int64)) for x in (before, word, further))], names=["label", "context", "word", "further"])


def _found(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Place of each wanted value among sorted keys, or -1."""
    if not len(keys):
        return np.full(len(want), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


def smoothed(word: np.ndarray, shared: np.ndarray, seen: np.ndarray, total: np.ndarray, types: np.ndarray, least: int = LEAST, ratio: float = RATIO):
    """Lowest order: (kept words in order, log probabilities of both classes, those of any other word).

    shared: contexts of a word in either class; seen: in each class; total and types: sums of seen, and words seen, over all words of each class.
    A class takes DISCOUNT off every count, and gives out DISCOUNT for every kept word by the shared counts. Words that are rare, or much alike in both
    classes, have no entry: their mass is the class's rest.
    """
    share = shared / max(shared.sum(), 1)
    p = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * types * share[:, None]) / np.maximum(total, 1)
    keep = seen.sum(axis=1) >= least
    keep[keep] = np.abs(np.log(p[keep, 1]) - np.log(p[keep, 0])) >= np.log(ratio)
    order = np.argsort(word[keep])
    word, seen, shared = word[keep][order], seen[keep][order], shared[keep][order]
    p = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * len(word) * (shared / max(shared.sum(), 1))[:, None]) / np.maximum(total, 1)
    return word, np.log(np.maximum(p, 1e-12)), np.log(np.maximum(1 - p.sum(axis=0), 1e-12))


def train(labelled: DataFrame, text: str = "text", label: str = "label") -> Model:
    """The two models from rows of (text, label 0 or 1); their number should be bounded, as the model is made on the driver from what was counted.

    Kneser-Ney counts at both orders: a word counts the words before it, a pair of words the words before the pair, so copies of a text count once.
    """
    slim = labelled.filter(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
    seen = slim.mapInArrow(_contexts_pass, "label int, context long, word long, further long").distinct()
    of = lambda k: F.sum(F.when(F.col("label") == k, 1).otherwise(0))
    pairs = stored(seen.groupBy("context", "word").agg(of(0).alias("n0"), of(1).alias("n1")), "toxicity-pairs")
    has = lambda k: F.sum((F.col(f"n{k}") > 0).cast("long"))
    words = stored(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("shared"), has(0).alias("n0"), has(1).alias("n1")), "toxicity-words")
    sums = words.agg(*(F.coalesce(f, F.lit(0)).cast("double") for f in (F.sum("n0"), F.sum("n1"), F.sum((F.col("n0") > 0).cast("long")), F.sum((F.col("n1") > 0).cast("long"))))).first()
    total, types = np.array(sums[:2]), np.array(sums[2:])
    kept = words.filter(F.col("n0") + F.col("n1") >= LEAST).toPandas()  # a fraction of the sample's words
    rest_shared = words.filter(F.col("n0") + F.col("n1") < LEAST).agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0]
    hashes = kept["word"].to_numpy(np.int64).view(np.uint64)
    # One row stands for all rare words, so that shares are those of the whole.
    word, word_log, rest = smoothed(np.append(hashes, np.uint64(0)), np.append(kept["shared"].to_numpy(np.float64), rest_shared), np.vstack([kept[["n0", "n1"]].to_numpy(np.float64), np.zeros((1, 2))]), total, types)
    often = pairs.filter(F.col("n0") + F.col("n1") >= LEAST)
    near = often.join(pairs.groupBy("context").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), has(0).alias("k0"), has(1).alias("k1")), "context").toPandas()  # a fraction of the sample's pairs
    w, c = (near[x].to_numpy(np.int64).view(np.uint64) for x in ("word", "context"))
    n, t, k = (near[[f"{x}0", f"{x}1"]].to_numpy(np.float64) for x in "ntk")
    at = _found(word, w)
    below = np.exp(np.where((at >= 0)[:, None], word_log[at] if len(word) else 0.0, rest))
    p = np.where(t > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * k * below) / np.maximum(t, 1), below)
    keep = np.abs(np.log(p[:, 1] / p[:, 0]) - np.log(below[:, 1] / below[:, 0])) >= np.log(RATIO)
    w, c, p, below = w[keep], c[keep], p[keep], below[keep]
    contexts, of_context = np.unique(c, return_inverse=True)
    taken, free = (np.stack([np.bincount(of_context, x[:, i], minlength=len(contexts)) for i in (0, 1)], axis=1) for x in (p, np.where(_found(word, w)[:, None] >= 0, below, 0.0)))
    back = np.log(np.maximum(1 - taken, 1e-12)) - np.log(np.maximum(1 - free, 1e-12))
    key = _pair(c, w)
    order = np.argsort(key)
    return Model(word, word_log, rest, key[order], np.log(p[order]), contexts, back)


def log_likelihoods(model: Model, word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log P(word | word before) in both classes: the pair's entry, else the context's weight and the word's entry, else the shared backoff."""
    at = _found(model.words, word)
    out = np.where((at >= 0)[:, None], model.word_log[at] if len(model.words) else 0.0, model.rest)
    below = _found(model.contexts, before)
    out = out + np.where((below >= 0)[:, None], model.back[below] if len(model.contexts) else 0.0, 0.0)
    pair = _found(model.pairs, _pair(before, word))
    return np.where((pair >= 0)[:, None], model.pair_log[pair] if len(model.pairs) else 0.0, out)


def compared(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", scale: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(key, n_words, ordinary, toxic, score) per input row: mean log-likelihoods of a word in both classes, and their difference as a score from 0 to 1.

    Texts are read whole, in one task each, at some 60 bytes of memory a byte. Null and empty texts, and texts without words, have means of 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    a, b = scale

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, rows, doc, word, before, _ in tokens(batch.column(1)):
                logs = log_likelihoods(m, word, before)
                n = np.bincount(doc, minlength=rows)
                mean = [np.bincount(doc, logs[:, i], minlength=rows) / np.maximum(n, 1) for i in (0, 1)]
                score = 1 / (1 + np.exp(-np.clip(a + b * compressed(mean[1] - mean[0]), -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(n), pa.array(mean[0]), pa.array(mean[1]), pa.array(score)], names=["id", "n_words", "ordinary", "toxic", "score"])

    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_words long, ordinary double, toxic double, score double")
    return out.withColumnRenamed("id", key)


def compressed(ratio: np.ndarray) -> np.ndarray:
    return np.arcsinh(ratio / UNIT)


def calibrated(ratio: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b): logistic regression of the label on the compressed ratio, both classes of equal weight; (0, 0), a score of 0.5, unless both are there."""
    x, y = compressed(ratio), label.astype(np.float64)
    if not 0 < y.sum() < len(y):
        return 0.0, 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    design, theta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    hold = np.diag([1e-6, RIDGE])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + hold @ theta
        move = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + hold, slope)
        theta = theta - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-10:
            break
    return float(theta[0]), max(float(theta[1]), 0.0)


def toxicity(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", rows: int = CLASS_ROWS) -> DataFrame:
    """compared() for docs, with models and scale learnt from rows of labelled (key, text, label), at most `rows` of each class, those with the least hash of their key.

    One in CALIBRATION of these rows (by hash of the key) sets the scale, the others the models. Rows with a null label or another than 0 and 1 teach
    nothing; null texts are empty; repeated rows count once for their words and each for the scale. If a class is missing all scores are 0.5. An empty table
    gives an empty result. Other columns are not looked at.
    """
    known = labelled.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sample = [hashed_sample(known.filter(F.col("label") == k), "id", rows) for k in (0, 1)]
    known = stored(sample[0].union(sample[1]), "toxicity-sample")
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(CALIBRATION)) == 0
    model = train(known.filter(~part))
    held = known.filter(part)
    found = held.withColumn("id", F.struct("id", "label")).transform(lambda d: compared(d, model, "id", "text")).select((F.col("toxic") - F.col("ordinary")).alias("ratio"), "id.label").toPandas()  # a fraction of the sample
    scale = calibrated(found["ratio"].to_numpy(np.float64), found["label"].to_numpy(np.float64))
    return compared(docs, model, key, text, scale)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    held: Column = crc_of(F.col("doc_id")) % 3 == 1
    labels = labels.filter(~held & F.col("label").isin(0, 1))
    chosen = [hashed_sample(labels.filter(F.col("label") == k), "doc_id", CLASS_ROWS) for k in (0, 1)]
    out = toxicity(docs, docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id"))  # 2 * CLASS_ROWS ids at most are broadcast
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_words", F.col("ordinary").alias("ordinary_log"), F.col("toxic").alias("toxic_log"))
