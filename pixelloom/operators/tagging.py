"""Zero-shot tags, open vocabulary, facets over tags and concepts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot
from ..sources.scratch import sized, stored


def prototypes(table: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """(label, vector): normalised mean vector of each label."""
    long = table.select(F.col(label).alias("label"), F.posexplode(F.col(vec).cast("array<double>")).alias("p", "x"))
    mean = long.groupBy("label", "p").agg(F.avg("x").alias("x"))
    whole = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("px"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return whole.select("label", F.transform("px", lambda e: e.x / F.col("norm")).alias("vector"))


def label_scores(table: DataFrame, labels: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, label, score) of every row against every label vector. Labels are broadcast if they are few, else joined block by block."""
    return table.select(key, vec).crossJoin(sized(stored(labels, "labels"))).select(key, "label", dot(F.col(vec), F.col("vector")).alias("score"))


def best_tag(scores: DataFrame, key: str = "vec_id", least: float = 0.0, scale: float = 100.0) -> DataFrame:
    """(key, label, score, confidence): the best label (ties: least label), with its softmax share; rows below `least` are dropped."""
    top = scores.groupBy(key).agg(F.max(F.struct("score", -F.col("label"))).alias("t"), F.collect_list("score").alias("all"))
    best = F.col("t.score")
    share = 1 / F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(scale * (x - best)))
    return top.filter(best >= least).select(key, (-F.col("t.col2")).alias("label"), best.alias("score"), share.alias("confidence"))


def top_concepts(scores: DataFrame, n: int, least: float, key: str = "vec_id") -> DataFrame:
    """(key, label, score, rank) of at most n labels that reach `least`."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "label")
    return scores.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _top(shared, n: int, least: float, kind: pa.DataType):
    """(key, label, score, rank) of the best n labels of a block for each row that reach `least`; ties go to the smaller label."""

    def run(batches):
        names, vectors = shared.value  # labels in order, so that a stable sort leaves equal scores by label
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = v @ vectors.T
            rows, ranks, labels = [], [], []
            some = min(n, len(names))
            floor = np.maximum(np.partition(scores, len(names) - some, axis=1)[:, len(names) - some], least)  # the n-th best of each row
            for i in range(len(v)):
                near = np.flatnonzero(scores[i] >= floor[i])
                best = near[np.argsort(-scores[i][near], kind="stable")][:n]
                rows.append(np.full(len(best), i))
                ranks.append(np.arange(1, len(best) + 1))
                labels.append(best)
            row, label = np.concatenate(rows), np.concatenate(labels)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([names[x] for x in label], kind), pa.array(scores[row, label]), pa.array(np.concatenate(ranks).astype(np.int32))], names=["k", "label", "score", "rank"])

    return run


def top_labels(table: DataFrame, labels: DataFrame, n: int, least: float, key: str = "vec_id", vec: str = "embedding", block: int = 20_000) -> DataFrame:
    """(key, label, score, rank) of at most n labels (label, vector) that reach `least`, for each row.

    Rows meet the labels as a matrix product, and only n labels of a row leave it. Labels beyond `block`, which are what a task holds, are taken block by block;
    then the best of all blocks are chosen. Rows and labels without a vector have none. Ties go to the smaller label.
    """
    spark = table.sparkSession
    labels = stored(labels.select("label", F.col("vector").cast("array<double>").alias("vector")).filter("label is not null and vector is not null"), "labels")
    rows = table.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).filter("k is not null and v is not null")
    types = rows.schema["k"].dataType.simpleString(), labels.schema["label"].dataType.simpleString()
    blocks = max(1, -(-labels.count() // block))
    out = None
    for b in range(blocks):
        part = sorted(labels.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b).collect(), key=lambda r: r["label"])  # about `block` rows
        shared = spark.sparkContext.broadcast(([r["label"] for r in part], np.array([r["vector"] for r in part])))
        found = rows.mapInArrow(_top(shared, n, least, to_arrow_type(labels.schema["label"].dataType)), f"k {types[0]}, label {types[1]}, score double, rank int")
        out = found if out is None else out.union(found)
    if blocks > 1:
        w = Window.partitionBy("k").orderBy(F.desc("score"), "label")  # n rows of each block
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return out.withColumnRenamed("k", key)


def concept_overview(concepts: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(label, n, first) of each concept, for lists by frequency."""
    return concepts.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))


def facets(tags: DataFrame) -> DataFrame:
    """(category, tag_values) sorted and distinct from a map column `tags`."""
    return tags.select(F.explode("tags").alias("category", "value")).groupBy("category").agg(F.array_sort(F.collect_set("value")).alias("tag_values"))


def with_tag(table: DataFrame, category: str, value: str) -> DataFrame:
    return table.filter(F.lower(F.try_element_at("tags", F.lit(category))) == value.lower())


def with_concept(table: DataFrame, value: str) -> DataFrame:
    return table.filter(F.exists("concepts", lambda c: F.lower(c) == value.lower()))


#: Fixed value: the category whose values are concepts.
CONCEPTS = "Erkannt"


def with_category(table: DataFrame, category: str, value: str) -> DataFrame:
    """Rows with a concept, if the category is that of concepts, else with a tag."""
    return with_concept(table, value) if category.lower() == CONCEPTS.lower() else with_tag(table, category, value)
