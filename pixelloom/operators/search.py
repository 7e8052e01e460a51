"""Vector search: similarity to a query row, top-k, thresholds, several collections, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import similarity
from .components import connected_components
from .pairs import cosine_links


def with_similarity(table: DataFrame, query: DataFrame, vec: str = "embedding", metric=similarity) -> DataFrame:
    """Adds `score` against the one vector of `query` (its first row; no row gives no result)."""
    one = query.select(F.col(vec).alias("_q")).limit(1)  # one row: safe to broadcast
    return table.crossJoin(F.broadcast(one)).withColumn("score", metric(F.col(vec), F.col("_q"))).drop("_q")


def top_k(scored: DataFrame, k: int, key: str, least: float | None = None, score: str = "score") -> DataFrame:
    """The k best rows, ties by key. Spark keeps k rows for each partition, nothing is sorted whole."""
    kept = scored if least is None else scored.filter(F.col(score) >= least)
    return kept.orderBy(F.desc(score), key).limit(k)


def best_per_key(scored: DataFrame, key: Column, score: str = "score") -> DataFrame:
    """Highest score for each key, for hits from several collections."""
    return scored.groupBy(key.alias("key")).agg(F.max(score).alias("score"))


def gap_at(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """One row: how many reach the threshold, the lowest that does, the highest that doesn't and the gap between."""
    above, below = F.min(F.when(F.col(score) >= threshold, F.col(score))), F.max(F.when(F.col(score) < threshold, F.col(score)))
    return scored.agg(F.count_if(F.col(score) >= threshold).alias("kept"), above.alias("lowest_kept"), below.alias("highest_dropped"), (above - below).alias("gap"))


def chain(table: DataFrame, start: DataFrame, near: float, anchor: float, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Keys that a chain of neighbours (similarity >= near) reaches from the start row, all of them with similarity >= anchor to it.

    The anchor test comes first: it does not depend on the chain and leaves few rows for the pairs.
    """
    first = start.select(F.col(key).alias("_s"), F.col(vec)).limit(1)
    close = with_similarity(table, first, vec).filter(F.col("score") >= anchor).select(key, vec)
    parts = connected_components(cosine_links(close, near, key, vec))
    own = parts.join(F.broadcast(first.select(F.col("_s").alias("id"))), "id").select("component")
    reached = parts.join(F.broadcast(own), "component").select(F.col("id").alias(key))
    return reached.union(first.select(F.col("_s").alias(key))).distinct()
