"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every vertex of an edge with the smallest vertex that it can reach.

    Each round gives a vertex the least label among its neighbours and then the label of its label
    (pointer jumping), so the rounds needed grow with the logarithm of the longest path for the
    usual shapes. Labels are written between rounds. Edges with a null end are ignored; loops make
    a vertex of its own.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = stored(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("id"), "label"), "cc-labels")
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["id"] == near["u"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = stored(least, "cc-least")
        up = least.select(F.col("id").alias("parent"), F.col("label").alias("grand"))
        jumped = least.join(up, least["label"] == up["parent"], "left").select("id", "old", F.least("label", F.coalesce("grand", "label")).alias("label"))
        jumped = stored(jumped, "cc-jumped")
        labels = jumped.select("id", "label")
        if not jumped.filter("old <> label").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
