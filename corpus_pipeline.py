"""Corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, source mixing, sharding.

Every stage takes the documents that the stage before kept, as rows of the documents table, and acts
on all of them. Near duplicates are found with the defaults for near-duplicate operators: five words
and a similarity of 0.8.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.decontamination import decontaminate
from pixelloom.llm.jaccard_join import jaccard_classes
from pixelloom.llm.mixing import mix, word_count
from pixelloom.llm.quality_rules import quality_rules
from pixelloom.llm.shared import WORD, shared_dir, stored
from pixelloom.llm.sharding import shard_by_curve

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
N_SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    The verdict is exploded rather than filtered: a filter would be pushed below the projections that
    build the counts, which would copy their expressions into each other.
    """
    judged = quality_rules(docs.select(*COLUMNS))
    return judged.withColumn("_kept", F.explode(F.when(F.col("kept"), F.array(F.lit(1))))).select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest doc_id (null last; ties by a hash of the row).

    Rows are told apart by a number of their own, written with them, so that rows without doc_id and rows
    that share one are judged each by its own text. Texts without words stand alone; equal rows stay once.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    classes = stored(jaccard_classes(rows, key="_row"), "pipeline-classes")
    # Digests are made before the join, so that it shuffles no texts.
    wordless = F.when(~F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False)), F.sha2(F.to_json(F.struct(*COLUMNS)), 256))
    slim = rows.select("_row", "doc_id", F.xxhash64(*COLUMNS).alias("_hash"), wordless.alias("_equal")).join(classes, "_row").withColumn("_class", F.when(F.col("n_shingles") > 0, F.col("component_id")))
    first = slim.groupBy("_class", "_equal").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash", "_row")).alias("m"))
    near = stored(first.select(F.col("m._row").alias("_row")), "pipeline-near").hint("shuffle_hash")  # a row for each kept document: never broadcast
    return rows.join(near, "_row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. The text alone decides, so rows are matched by its digest."""
    docs = docs.select(*COLUMNS).withColumn("_digest", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_digest")
    hit = stored(found.filter("contaminated").select("_digest").distinct(), "pipeline-contaminated")
    return docs.join(hit, "_digest", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix(docs.select(*COLUMNS), F.array("source"), word_count(F.col("text")))
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places: doc_id, size, text_crc32, curve, shard and slot."""
    return shard_by_curve(docs.select(*COLUMNS), N_SHARDS)


STAGES = [
    ("quality_rules", keep_quality),
    ("jaccard_join", keep_one_of_near),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Flow, seeded selection and the curve order can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{top}/{k}-{name}")
    return docs
