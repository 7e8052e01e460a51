"""Column functions over the vocabularies of public tokenizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_vocabulary(word: Column, vocabulary) -> Column:
    """Whether a word is whole in a vocabulary of words that end in </w> (a small, fixed array)."""
    return F.array_contains(F.array(*map(F.lit, vocabulary)), F.concat(F.lower(word), F.lit("</w>")))


def with_vocabulary(rows: DataFrame, vocabulary: DataFrame, word: str = "word", entry: str = "entry") -> DataFrame:
    """Adds `known`: whether a row's word is whole in a vocabulary table of any size, whose words end in </w>; null words are not known."""
    from ..sources.scratch import sized, stored

    entries = sized(stored(vocabulary.select(F.col(entry).alias("_entry")).filter(F.endswith("_entry", F.lit("</w>"))).distinct(), "vocabulary"))
    out = rows.join(entries, F.concat(F.lower(word), F.lit("</w>")) == F.col("_entry"), "left")
    return out.withColumn("known", F.col("_entry").isNotNull()).drop("_entry")
