"""Queries over vectors: search, tags, preference, calibration, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import average_hash, calibrated_similarity, difference_hash, hamming, normalised
from ..operators import calibration, preference, scope, search, tagging
from ..operators.components import connected_components
from ..operators.pairs import cosine_links, cosine_pairs, hamming_links, hamming_pairs
from .registry import registry

QUERIES, SQL, query = registry()


def emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _q0(spark, d):
    return emb(spark, d).filter("vec_id = 0")


_SCORED = """scored AS (SELECT e.vec_id, e.label, greatest(0.0, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


@query("vector_topk", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    out = search.top_k(search.with_similarity(emb(spark, d), _q0(spark, d)), 10, "vec_id")
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query("vector_threshold", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE scored.score >= 0.30")
def vector_threshold(spark, d):
    return search.with_similarity(emb(spark, d), _q0(spark, d)).filter("score >= 0.30").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_percent_render", f"""WITH {_SCORED} SELECT vec_id, CASE WHEN score < 0.24 THEN 'weak' WHEN score < 0.30 THEN 'fair' ELSE 'good' END AS class,
 floor(score * 100 + 0.5)::BIGINT || ' %' AS percent FROM (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 60) WHERE score >= 0.15""")
def vector_percent_render(spark, d):
    top = search.top_k(search.with_similarity(emb(spark, d), _q0(spark, d)), 60, "vec_id").filter("score >= 0.15")
    kind = F.when(F.col("score") < 0.24, "weak").when(F.col("score") < 0.30, "fair").otherwise("good")
    return top.select("vec_id", kind.alias("class"), F.concat(F.floor(F.col("score") * 100 + 0.5).cast("string"), F.lit(" %")).alias("percent"))


@query("multi_collection_search", f"WITH {_SCORED} SELECT vec_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r = 1")
def multi_collection_search(spark, d):
    scored = search.with_similarity(emb(spark, d), _q0(spark, d))
    best = scored.groupBy("label").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("neg"))).alias("m"))
    return best.select((-F.col("m.neg")).alias("vec_id"), "label", F.round("m.score", 6).alias("score"))


@query("series_search_raw", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) AND scored.score >= 0.2")
def series_search_raw(spark, d):
    e = emb(spark, d)
    own = e.join(F.broadcast(_q0(spark, d).select("label")), "label")
    return search.with_similarity(own, _q0(spark, d)).filter("score >= 0.2").select("vec_id", F.round("score", 6).alias("score"))


@query("schema_gap_stats", f"WITH {_SCORED} SELECT count(*) FILTER (score >= 0.3)::BIGINT AS kept, round(min(score) FILTER (score >= 0.3), 6) AS lowest_kept, round(max(score) FILTER (score < 0.3), 6) AS highest_dropped, round(min(score) FILTER (score >= 0.3) - max(score) FILTER (score < 0.3), 6) AS gap FROM scored")
def schema_gap_stats(spark, d):
    out = search.gap_at(search.with_similarity(emb(spark, d), _q0(spark, d)), 0.3)
    return out.select("kept", *(F.round(c, 6).alias(c) for c in ("lowest_kept", "highest_dropped", "gap")))


_PAIRS = "pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.40)"
_REACH = """edge AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
 comp AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""


@query("cosine_pairs", f"WITH {_PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs")
def q_cosine_pairs(spark, d):
    return cosine_pairs(emb(spark, d), 0.40).select("a", "b", F.round("score", 6).alias("score"))


@query("cosine_components", f"WITH RECURSIVE {_PAIRS}, {_REACH} SELECT id, component, count(*) OVER (PARTITION BY component)::BIGINT AS members FROM comp")
def cosine_components(spark, d):
    parts = connected_components(cosine_links(emb(spark, d), 0.40))
    return parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component").select("id", "component", "members")


@query("cosine_groups_ranked", f"""WITH RECURSIVE {_PAIRS}, {_REACH}
 SELECT comp.id, component, round(CASE WHEN comp.id = component THEN 1.0 ELSE greatest(0.0, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) END, 6) AS score
 FROM comp JOIN embeddings x ON x.vec_id = comp.id JOIN embeddings y ON y.vec_id = component""")
def cosine_groups_ranked(spark, d):
    from ..functions.vectors import similarity

    e = emb(spark, d)
    parts = connected_components(cosine_links(e, 0.40))
    own, rep = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("component"), F.col("embedding").alias("y"))
    score = F.when(F.col("id") == F.col("component"), F.lit(1.0)).otherwise(similarity(F.col("x"), F.col("y")))
    return parts.join(own, "id").join(rep, "component").select("id", "component", F.round(score, 6).alias("score"))


@query("chain_search", f"""WITH RECURSIVE {_SCORED}, near AS (SELECT s.vec_id, e.embedding::DOUBLE[] AS v FROM scored s JOIN embeddings e USING (vec_id) WHERE s.score >= 0.10),
 edge AS (SELECT x.vec_id AS a, y.vec_id AS b FROM near x JOIN near y ON x.vec_id <> y.vec_id WHERE list_inner_product(x.v, y.v) >= 0.30),
 reach(id) AS (SELECT 0::BIGINT UNION SELECT edge.b FROM reach JOIN edge ON reach.id = edge.a) SELECT id AS vec_id FROM reach""")
def chain_search(spark, d):
    return search.chain(emb(spark, d), _q0(spark, d), 0.30, 0.10)


# Tags: prototypes are the normalised mean vectors of the labels.
_PROTO = """long AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
 mean AS (SELECT label, p, avg(x) AS x FROM long GROUP BY ALL), proto AS (SELECT label, p, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM mean),
 s AS (SELECT long.vec_id, proto.label, sum(long.x * proto.x) AS score FROM long JOIN proto USING (p) GROUP BY ALL)"""


def _top_labels(spark, d):
    return tagging.top_labels(emb(spark, d), tagging.prototypes(emb(spark, d)), 3, 0.05)


def _scores(spark, d):
    return tagging.label_scores(emb(spark, d), tagging.prototypes(emb(spark, d)))


@query("label_prototypes", f"WITH {_PROTO} SELECT label::BIGINT AS label, (p - 1)::BIGINT AS p, round(x, 6) AS x FROM proto")
def label_prototypes(spark, d):
    return tagging.prototypes(emb(spark, d)).select(F.col("label").cast("long").alias("label"), F.posexplode("vector").alias("p", "x")).select("label", F.col("p").cast("long").alias("p"), F.round("x", 6).alias("x"))


@query("zero_shot_tags", f"WITH {_PROTO} SELECT vec_id, label::BIGINT AS label, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1 AND s.score >= 0.2".replace("s.score", "score"))
def zero_shot_tags(spark, d):
    return tagging.best_tag(_scores(spark, d), least=0.2).select("vec_id", F.col("label").cast("long").alias("label"), F.round("score", 5).alias("score"))


@query("zero_shot_confidence", f"WITH {_PROTO} SELECT vec_id, round(1 / sum(exp(100 * (score - top))), 4) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM s) GROUP BY vec_id")
def zero_shot_confidence(spark, d):
    return tagging.best_tag(_scores(spark, d), least=-1.0).select("vec_id", F.round("confidence", 4).alias("confidence"))


_TOP = f"{_PROTO}, top AS (SELECT vec_id, label::BIGINT AS label, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 3)"


@query("open_vocab_topn", f"WITH {_TOP} SELECT vec_id, label, round(score, 5) AS score, rank::BIGINT AS rank FROM top")
def open_vocab_topn(spark, d):
    return _top_labels(spark, d).select("vec_id", F.col("label").cast("long").alias("label"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("concept_overview", f"WITH {_TOP} SELECT label, count(*)::BIGINT AS n, min(vec_id) AS first FROM top GROUP BY label")
def concept_overview(spark, d):
    return tagging.concept_overview(_top_labels(spark, d)).select(F.col("label").cast("long").alias("label"), "n", "first")


def _tagged(spark, d):
    return emb(spark, d).select("vec_id", F.create_map(F.lit("Label"), F.concat(F.lit("L"), F.col("label").cast("string")), F.lit("Parity"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")).alias("tags"), F.array(F.concat(F.lit("C"), (F.col("vec_id") % 7).cast("string"))).alias("concepts"))


@query("concept_facets", "SELECT 'Label' AS category, string_agg(DISTINCT 'L' || label, ',' ORDER BY 'L' || label) AS facet FROM embeddings UNION ALL SELECT 'Parity', 'even,odd'")
def concept_facets(spark, d):
    return tagging.facets(_tagged(spark, d)).select("category", F.array_join("tag_values", ",").alias("facet"))


@query("tag_filter", "SELECT vec_id FROM embeddings WHERE label = 3")
def tag_filter(spark, d):
    return tagging.with_category(_tagged(spark, d), "Label", "l3").select("vec_id")


@query("concept_filter", "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 4")
def concept_filter(spark, d):
    return tagging.with_category(_tagged(spark, d), "erkannt", "c4").select("vec_id")


# Preference: odd ids are the rejected side, labels the folders.
def _sides(spark, d):
    return emb(spark, d).withColumn("bad", F.col("vec_id") % 2 == 1).withColumn("folder", F.col("label"))


_LONG = "long AS (SELECT vec_id, label, vec_id % 2 = 1 AS bad, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"
_DIR = "dir AS (SELECT p, avg(x) FILTER (bad) - avg(x) FILTER (NOT bad) AS d FROM long GROUP BY p)"


@query("fav_centroid", f"WITH {_LONG}, {_DIR} SELECT p::BIGINT AS p, round(d, 6) AS d FROM dir")
def fav_centroid(spark, d):
    return preference.centroid_direction(preference.side_sums(_sides(spark, d))).select(F.col("p").cast("long").alias("p"), F.round("d", 6).alias("d"))


@query("fav_pooled", f"WITH {_LONG}, f AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) FILTER (vec_id % 2 = 1) >= 5 AND count(*) FILTER (vec_id % 2 = 0) >= 5) SELECT p::BIGINT AS p, round(avg(x) FILTER (bad) - avg(x) FILTER (NOT bad), 6) AS d FROM long WHERE label <> 3 AND label IN (SELECT label FROM f) GROUP BY p")
def fav_pooled(spark, d):
    return preference.pooled_direction(preference.side_sums(_sides(spark, d), "folder"), 3).select(F.col("p").cast("long").alias("p"), F.round("d", 6).alias("d"))


@query("fav_rank_minmax", f"WITH {_LONG}, {_DIR}, u AS (SELECT p, d / sqrt(sum(d * d) OVER ()) AS d FROM dir), s AS (SELECT vec_id, sum(x * d) AS s FROM long JOIN u USING (p) GROUP BY vec_id) SELECT vec_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 5) AS rating FROM s")
def fav_rank_minmax(spark, d):
    t = _sides(spark, d)
    vector = preference.as_vector(preference.centroid_direction(preference.side_sums(t)))
    return preference.ranked(t, vector).select("vec_id", F.round("rating", 5).alias("rating"))


@query("fav_ridge_rank")
def fav_ridge_rank(spark, d):
    t = _sides(spark, d)
    direction = preference.ridge_direction(t)
    vector = spark.createDataFrame([([float(x) for x in direction],)] if direction is not None else [], "vector array<double>")
    return preference.ranked(t, vector).select("vec_id", F.round("rating", 5).alias("rating"))


# Calibration.
_CENTRED = "long AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), c AS (SELECT vec_id, p, x - avg(x) OVER (PARTITION BY p) AS x FROM long), u AS (SELECT vec_id, p, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM c)"


@query("calib_mean_center", "SELECT (p - 1)::BIGINT AS p, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY p")
def calib_mean_center(spark, d):
    return calibration.mean_vector(emb(spark, d)).select(F.posexplode("mean").alias("p", "mean")).select(F.col("p").cast("long").alias("p"), F.round("mean", 6).alias("mean"))


@query("calib_similarity", f"WITH {_CENTRED} SELECT u.vec_id, round(least(1.0, greatest(0.0, (sum(u.x * q.x) + 1) / 2)), 5) AS score FROM u JOIN u q ON q.vec_id = 0 AND q.p = u.p GROUP BY u.vec_id")
def calib_similarity(spark, d):
    c = calibration.centred(emb(spark, d))
    out = search.with_similarity(c, c.filter("vec_id = 0"), metric=calibrated_similarity)
    return out.select("vec_id", F.round("score", 5).alias("score"))


@query("calib_pca_search")
def calib_pca_search(spark, d):
    e = emb(spark, d)
    mean, pcs = calibration.fit(e, 2)
    c = e.withColumn("embedding", calibration.applied(F.col("embedding"), mean, pcs))
    out = search.top_k(search.with_similarity(c, c.filter("vec_id = 0"), metric=calibrated_similarity), 20, "vec_id")
    return out.select("vec_id", F.round("score", 5).alias("score"))


@query("l2_normalise", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS old_norm, 1.0::DOUBLE AS new_norm FROM embeddings")
def l2_normalise(spark, d):
    from ..functions.vectors import norm

    return emb(spark, d).select("vec_id", F.round(norm(F.col("embedding")), 5).alias("old_norm"), F.round(norm(normalised(F.col("embedding"))), 6).alias("new_norm"))


# Hashes of the vectors as 8 x 8 rasters; compared as two halves of 32 bits.
def _half(cond: str, ranks: str) -> str:
    return f"list_sum(list_transform(range(0, 32), lambda i: CASE WHEN {cond} THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS {ranks}"


_AHASH = f"h AS (SELECT vec_id, {_half('e[i + 1] >= m', 'low')}, {_half('e[i + 33] >= m', 'high')} FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_sum(embedding::DOUBLE[]) / 64 AS m FROM embeddings))"


def _halves(h):
    return h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned(h, 32).alias("high")


def _hashed(spark, d):
    return emb(spark, d).select("vec_id", average_hash(F.col("embedding")).alias("hash"))


@query("ahash", f"WITH {_AHASH} SELECT vec_id, low, high FROM h")
def ahash(spark, d):
    return _hashed(spark, d).select("vec_id", *_halves(F.col("hash")))


_D = "e[(i // 7) * 8 + i % 7 + 1] > e[(i // 7) * 8 + i % 7 + 2]"


@query("dhash", f"WITH h AS (SELECT vec_id, {_half(_D, 'low')}, {_half(_D, 'high').replace('range(0, 32)', 'range(32, 56)').replace('<< i', '<< (i - 32)')} FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)) SELECT vec_id, low, high FROM h")
def dhash(spark, d):
    return emb(spark, d).select("vec_id", *_halves(difference_hash(F.col("embedding"), 8)))


_DIST = "(bit_count(xor(x.low, y.low)) + bit_count(xor(x.high, y.high)))::BIGINT"


@query("hamming_topk", f"WITH {_AHASH} SELECT x.vec_id, {_DIST} AS distance FROM h x, h y WHERE y.vec_id = 0 ORDER BY distance, x.vec_id LIMIT 10")
def hamming_topk(spark, d):
    h = _hashed(spark, d)
    q = h.filter("vec_id = 0").select(F.col("hash").alias("q")).limit(1)
    return h.crossJoin(F.broadcast(q)).select("vec_id", hamming(F.col("hash"), F.col("q")).cast("long").alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("hamming_filter", f"WITH {_AHASH} SELECT x.vec_id FROM h x, h y WHERE y.vec_id = 0 AND ({_DIST} <= 24 OR (x.low = 0 AND x.high = 0))")
def hamming_filter(spark, d):
    h = _hashed(spark, d)
    q = h.filter("vec_id = 0").select(F.col("hash").alias("q")).limit(1)
    return h.crossJoin(F.broadcast(q)).filter((hamming(F.col("hash"), F.col("q")) <= 24) | (F.col("hash") == 0)).select("vec_id")


@query("hamming_pairs", f"WITH {_AHASH} SELECT x.vec_id AS a, y.vec_id AS b, {_DIST} AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id AND {_DIST} <= 20")
def q_hamming_pairs(spark, d):
    return hamming_pairs(_hashed(spark, d), 20).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("hamming_components", f"WITH RECURSIVE {_AHASH}, pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM h x JOIN h y ON x.vec_id < y.vec_id AND {_DIST} <= 18), {_REACH} SELECT id, component FROM comp")
def hamming_components(spark, d):
    return connected_components(hamming_links(_hashed(spark, d), 18)).select("id", "component")


@query("scoped_search", f"WITH {_SCORED.replace('greatest(0.0, ', '(')} SELECT vec_id, 'set/' || label AS folder, round(score, 6) AS score FROM scored WHERE label % 2 = 0 ORDER BY scored.score DESC, vec_id LIMIT 10")
def scoped_search(spark, d):
    """The nearest to vector 0 among the folders of even labels, its own first; folders that can't hold a hit are not read."""
    index = emb(spark, d).withColumn("folder", F.concat(F.lit("set/"), F.col("label").cast("string")))
    known = index.filter("label % 2 = 0").select(F.col("folder").alias("path"))
    hits, _ = scope.scoped_top_k(index, scope.summaries(index), scope.scope(known, "set/0"), _q0(spark, d).first()["embedding"], 10)
    return hits.select("vec_id", "folder", F.round("score", 6).alias("score"))


@query("fav_blended_rank")
def fav_blended_rank(spark, d):
    """Label 3 as a folder, ranked by its own direction blended with that of all others; no SQL, as it solves a system."""
    t = _sides(spark, d)
    own = t.filter("folder = 3")
    direction = preference.folder_vector(own, preference.side_sums(t, "folder"), 3)
    vector = spark.createDataFrame([([float(x) for x in direction],)] if direction is not None else [], "vector array<double>")
    return preference.positions(preference.ranked(own, vector)).select("vec_id", F.round("rating", 5).alias("rating"), "position")
