"""Benchmark decontamination: a prefix-filtered set join with exact verification of item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, stored

#: Maximal runs of a-z, 0-9 and everything beyond ASCII, after A-Z became a-z.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(ITEM_WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, k: int) -> Column:
    """Hash of k words from the 0-based place `at`. It only proposes candidates; words decide."""
    return F.xxhash64(F.lit(k), *(F.get(words, at + i) for i in range(k)))


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(prefix, windows): for each prefix shingle the windows that it stands for, as structs of item, wlen, at and words.

    A window's shingles are ordered by rarity, that is by the number of windows that hold them, then by
    hash. All of a window must occur in a document, so its prefix is its rarest shingle alone: a
    document that holds the window holds that shingle, at the place `at` of the window.
    """
    items = benchmark.select(F.col(key).alias("item"), item_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    wins = items.select("item", n.alias("wlen"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice(F.col("w"), i + 1, n))).alias("words")).dropDuplicates()
    grams = None
    for k in range(1, shingle + 1):
        own = wins.filter(F.col("wlen") >= shingle if k == shingle else F.col("wlen") == k)
        own = own.withColumn("k", F.lit(k)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("wlen") - k))).withColumn("prefix", _shingle(F.col("words"), F.col("at"), k))
        grams = own if grams is None else grams.unionByName(own)
    grams = stored(grams, "benchmark-shingles")
    rarity = grams.groupBy("prefix").agg(F.count(F.lit(1)).alias("held_by"))
    chosen = grams.join(rarity, "prefix").groupBy("item", "wlen", "words").agg(F.min(F.struct("held_by", "prefix", "at", "k")).alias("best"))
    return chosen.groupBy(F.col("best.prefix").alias("prefix"), F.col("best.k").alias("k")).agg(F.collect_list(F.struct("item", "wlen", F.col("best.at").alias("at"), "words")).alias("windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, key: str = "doc_id", item_key: str = "item_id", text: str = "text", broadcast_prefixes: int = 20_000, broadcast_windows: int = 60_000) -> DataFrame:
    """Per input row: key, n_words, n_hit, n_items, items (sorted strings), items_sha256, contaminated.

    A window is `window` consecutive item words, or all words of a shorter item; a document word
    inside any occurrence of a window is hit. Null and empty texts have no words and no hits; an item
    without words has no window; repeated rows are judged one by one, also of one key; equally rare shingles of a window go by their hash. Only the key and the text of a
    document are looked at, so other columns may have any names. A text is judged in one task, in time linear in its length. The windows are broadcast only
    after their number was counted; beyond the bounds the join is shuffled, and rows carry only the
    words around their place.
    """
    prefixes = stored(benchmark_windows(benchmark, window, shingle, item_key), "benchmark-prefixes")
    found = prefixes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("windows")), F.lit(0)).alias("w"), F.collect_set("k").alias("ks")).first()
    small = found["n"] <= broadcast_prefixes and found["w"] <= broadcast_windows
    base = docs.select(F.col(key).alias("_key"), item_words(F.col(text)).alias("_words")).withColumn("_row", F.monotonically_increasing_id()).withColumn("_n", F.size("_words"))
    placed = base.select("_key", "_row", "_n", "_words", F.posexplode_outer("_words").alias("_pos", "_w")).drop("_w").withColumn("_pos", F.coalesce("_pos", F.lit(0)))
    if small:
        placed = placed.withColumn("_from", F.lit(0))
    else:
        placed = placed.withColumn("_from", F.greatest(F.col("_pos") - window, F.lit(0))).withColumn("_words", F.slice("_words", F.col("_from") + 1, F.lit(2 * window + shingle)))
    ks = sorted(found["ks"]) or [shingle]
    hashes = [_shingle(F.col("_words"), F.col("_pos") - F.col("_from"), k) for k in ks]
    placed = placed.withColumn("_hash", hashes[0] if len(ks) == 1 else F.explode(F.array(*hashes)))
    side = prefixes.select(F.col("prefix").alias("_hash"), "windows")
    joined = placed.join(F.broadcast(side) if small else side, "_hash", "left").filter(F.col("windows").isNotNull() | (F.col("_pos") == 0))
    each = joined.select("_key", "_row", "_n", "_words", "_pos", "_from", F.explode_outer("windows").alias("_win"))
    start = F.col("_pos") - F.col("_win.at")
    # Positional and length bounds first, then the words themselves.
    holds = F.coalesce((start >= 0) & (start + F.col("_win.wlen") <= F.col("_n")) & (F.slice("_words", F.greatest(start - F.col("_from"), F.lit(0)) + 1, F.col("_win.wlen")) == F.col("_win.words")), F.lit(False))
    spans = each.select("_key", "_row", "_n", F.when(holds, F.col("_win.item").cast("string")).alias("_item"), F.when(holds, F.struct(start.alias("s"), F.col("_win.wlen").alias("l"))).alias("_span"), F.col("_pos"))
    spans = spans.filter(F.col("_span").isNotNull() | (F.col("_pos") == 0))
    per = spans.groupBy("_row", "_key", "_n").agg(F.collect_set("_item").alias("_items"), F.collect_set("_span").alias("_spans"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("_spans", lambda x: F.sequence(x.s, x.s + x.l - 1)))))
    items = F.array_sort("_items")
    return per.select(
        F.col("_key").alias(key), F.col("_n").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), items.alias("items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)
), m AS (
  SELECT rid, i, pos.l, item_id FROM pos JOIN win USING (l, k)
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM m) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM m) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
