"""What all operators have in common: other columns, whatever their names, change nothing; empty tables; features and shards against plain counts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, corpus, words

from pixelloom.llm import centroid_clustering, chat_format, decontamination, jaccard_join, license_scan, lm_scoring, merkle_manifest, mixing, quality_classifier, quality_rules, sharding, suffix_dedup, toxicity

NAMES = "id key k n w h p words word context text2 size n_words n_shingles component component_id rep copies token pos tile part kind kept score label doc curve shard slot law taken target ids held tokens chunk sums rows blob spans lo hi tree leaf root path idx level prefix windows item items conv t turns shown at example formatted trained c r d1 d2 band lead masked whole _row _key _n _x".split()


@pytest.fixture(scope="module")
def plain(spark):
    rows = corpus(7, 30)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def crowded(plain):
    return plain.withColumns({n: F.lit("x") for n in NAMES})


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(shown(r[c]) for c in cols) for r in a.collect()) == sorted(tuple(shown(r[c]) for c in cols) for r in b.collect())


RUNS = {
    "classifier": lambda s, d: quality_classifier.score(d, np.linspace(-1, 1, (1 << quality_classifier.BITS) + 1, dtype=np.float32)),
    "repeats": lambda s, d: suffix_dedup.remove_repeats(d),
    "decontamination": lambda s, d: decontamination.decontaminate(d, s.createDataFrame([(1, corpus(7, 30)[3][1][20:200])], "item_id long, text string")),
    "jaccard": lambda s, d: jaccard_join.jaccard_classes(d),
    "rules": lambda s, d: quality_rules.quality_rules(d, sample_rows=10**6).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "shards": lambda s, d: sharding.shard_by_curve(d, 5),
    "model": lambda s, d: lm_scoring.lm_scores(d, F.col("doc_id") % 3 == 0),
    "licences": lambda s, d: license_scan.license_scan(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, d.withColumn("label", (F.col("doc_id") % 2).cast("int"))),
    "manifest": lambda s, d: merkle_manifest.manifest(d, merkle_manifest.COLUMNS),
    "clusters": lambda s, d: centroid_clustering.cluster(d.withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("doc_id")).cast("float"))), "doc_id", "v"),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_other_columns_change_nothing(spark, plain, crowded, name):
    same(RUNS[name](spark, plain), RUNS[name](spark, crowded))


def test_other_columns_of_mixed_documents_stay(plain, crowded):
    """The seeded order is by the whole row, so the documents differ, but not what sources get."""
    a, b = (mixing.mix(d, F.array("source"), mixing.word_count(F.col("text"))) for d in (plain, crowded))
    kept = [c for c in crowded.columns if c not in ("size", "copies", "taken", "target")]
    assert set(kept) < set(b.columns) and {r[0] for r in b.select("w").distinct().collect()} == {"x"}
    of = lambda d: {r.source: (r.source_size, round(r.target, 6)) for r in d.collect()}
    assert of(a) == of(b)
    for r in b.groupBy("source", "target").agg(F.sum("taken").alias("n"), F.max("size").alias("most")).collect():
        assert abs(r.n - r.target) <= max(0.02 * r.target, r.most)


def test_other_columns_of_turns_change_nothing(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {c} {t} <|im_end|>") for c in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    crowded = df.withColumns({n: F.lit("x") for n in NAMES})
    same(chat_format.expand_prefixes(df), chat_format.expand_prefixes(crowded))
    same(chat_format.read_back(chat_format.expand_prefixes(df)), chat_format.read_back(chat_format.expand_prefixes(crowded)))


def test_stages_take_documents_with_other_columns(spark, plain, crowded, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, corpus(7, 30)[3][1][20:200])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in cp.STAGES:
        same(stage(spark, plain, str(tmp_path)), stage(spark, crowded, str(tmp_path)))


def test_pipeline_over_no_documents(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_features_against_plain_ngrams():
    """Values of each text's slots are those of its n-grams of words and of word shapes, and texts share slots where they share n-grams."""
    texts = ["One two, one TWO three 44x", "one two Öl!! Öl!! a", "", "x", "two three one", "A1 b2 C3 d4 A1 b2"]

    def kind(b):
        return "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b)

    def grams(text):
        w = words(text)
        raw = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        shapes = [re.sub(r"(.)\1+", r"\1", "".join(map(kind, x))) for x in raw]
        return Counter((j, tuple(x[i : i + n])) for j, (x, n) in enumerate(((w, 1), (w, 2), (shapes, 1), (shapes, 2), (shapes, 3))) for i in range(len(x) - n + 1))

    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    doc, slot, value = quality_classifier.features(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [grams(t) for t in texts]
    got = [dict(zip(slot[doc == i].tolist(), value[doc == i].tolist(), strict=True)) for i in range(len(texts))]
    for g, w in zip(got, want, strict=True):
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in w.values()))
        assert sorted(g.values()) == pytest.approx(sorted(math.log1p(n) / norm for n in w.values()), abs=1e-6)
    for i in range(len(texts)):
        for j in range(i):
            assert len(got[i].keys() & got[j].keys()) == len(want[i].keys() & want[j].keys())


def test_curve_keeps_ranges_of_shards_narrow(spark):
    """A reader that asks for one source, or for small files, opens fewer shards than in an order by one dimension or by chance."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([5, 50, 500, 5000]), rng.choice(["de", "en", "fr", "es"]), f"s{rng.randrange(16):02}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard_by_curve(df, 64).select("doc_id", "shard").join(df, "doc_id").collect()
    held = {}
    for r in out:
        for c, v in (("source", r.source), ("lang", r.lang), ("length", len(r.text))):
            held.setdefault((c, r["shard"]), set()).add(v)
    mean = lambda c: np.mean([len(v) for (k, _), v in held.items() if k == c])
    assert mean("source") <= 6 and mean("lang") <= 2.5 and mean("length") <= 2.5  # of 16, 4 and 4
