"""Queries over vectors as 8 x 8 rasters and as fields of templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cyclic_similarity, normalised
from ..operators import masks, pictures, raster
from .registry import registry
from .vector_queries import emb

QUERIES, SQL, query = registry()


_PX = "px AS (SELECT vec_id AS image, ((p - 1) % 8)::BIGINT AS x, ((p - 1) // 8)::BIGINT AS y, v FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"


def _px(spark, d):
    return raster.pixels(emb(spark, d), 8)


def _rows(spark, d):
    return pictures.from_vectors(emb(spark, d), 8)


def _values(df):
    return pictures.pixels(df, "values").withColumnRenamed("values", "v")


def _gradients(spark, d):
    return pictures.pixels(pictures.sobel(_rows(spark, d)), "magnitude", "orientation", margin=1)


def _long(df, *values, digits=6):
    return df.select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *(F.round(v, digits).alias(v) for v in values))


def _box(r: int, out: str) -> str:
    return f"WITH {_PX} SELECT a.image, a.x, a.y, round({out}, 6) AS v FROM px a JOIN px b ON a.image = b.image AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} GROUP BY a.image, a.x, a.y, a.v"


@query("box_highpass", _box(6, "a.v - avg(b.v)"))
def box_highpass(spark, d):
    return _long(_values(pictures.high_pass(_rows(spark, d))), "v")


@query("blur3x3", _box(1, "avg(b.v)"))
def blur3x3(spark, d):
    return _long(_values(pictures.blurred(_rows(spark, d))), "v")


_SOBEL = f"""{_PX}, g AS (SELECT a.image, a.x, a.y, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) AS gx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) AS gy
 FROM px a JOIN px b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY ALL),
 sob AS (SELECT image, x, y, sqrt(gx * gx + gy * gy) AS m, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END AS o FROM g)"""


@query("sobel_edges", f"WITH {_SOBEL} SELECT image, x, y, round(m, 6) AS magnitude, round(o, 5) AS orientation FROM sob")
def sobel_edges(spark, d):
    out = _gradients(spark, d)
    return out.select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round("magnitude", 6).alias("magnitude"), F.round("orientation", 5).alias("orientation"))


@query("contour_binary", f"WITH {_SOBEL} SELECT image, count(*)::BIGINT AS edge_pixels FROM sob WHERE m * 255 > 90 GROUP BY image")
def contour_binary(spark, d):
    return _gradients(spark, d).filter(F.col("magnitude") * 255 > 90).groupBy("image").agg(F.count(F.lit(1)).alias("edge_pixels"))


_SHAPE = f"""{_SOBEL}, k AS (SELECT image, m, o / (pi() / 36) AS pos FROM (SELECT *, max(m) OVER (PARTITION BY image) AS top FROM sob) WHERE m > top * 0.10),
 e AS (SELECT image, floor(pos)::BIGINT % 36 AS bin, m * (1 - (pos - floor(pos))) AS w FROM k UNION ALL SELECT image, (floor(pos)::BIGINT % 36 + 1) % 36, m * (pos - floor(pos)) FROM k),
 hist AS (SELECT image, bin, sum(w) AS w FROM e GROUP BY ALL), shape AS (SELECT image, bin, w / sqrt(sum(w * w) OVER (PARTITION BY image)) AS w FROM hist)"""


def _shape(spark, d):
    return pictures.shape_descriptors(_rows(spark, d))


@query("shape_descriptor", f"WITH {_SHAPE} SELECT image, bin, round(w, 5) AS weight FROM shape")
def shape_descriptor(spark, d):
    out = _shape(spark, d).select("image", F.posexplode("descriptor").alias("bin", "weight")).filter("weight > 0")
    return out.select("image", F.col("bin").cast("long").alias("bin"), F.round("weight", 5).alias("weight"))


@query("shape_similarity_cyclic", f"""WITH {_SHAPE}, sh AS (SELECT unnest(range(0, 36)) AS s), r AS (SELECT a.image, s, sum(a.w * q.w) AS t
 FROM shape a CROSS JOIN sh JOIN shape q ON q.image = 0 AND a.bin = (q.bin + s) % 36 GROUP BY a.image, s) SELECT image, round(max(t), 5) AS score FROM r GROUP BY image""")
def shape_similarity_cyclic(spark, d):
    v = _shape(spark, d)
    q = v.filter("image = 0").select(F.col("descriptor").alias("q")).limit(1)
    return v.crossJoin(F.broadcast(q)).select("image", F.round(cyclic_similarity(F.col("q"), F.col("descriptor"), 36), 5).alias("score"))


@query("grey_spread", f"WITH {_PX} SELECT image, round(stddev_pop((v + 1) / 2 * 255) / 255, 6) AS spread FROM px GROUP BY image")
def grey_spread(spark, d):
    return raster.spread(_px(spark, d).withColumn("v", (F.col("v") + 1) / 2 * 255)).select("image", F.round("spread", 6).alias("spread"))


@query("edge_density", f"WITH {_PX}, n AS (SELECT image, (v + 1) / 2 * 255 AS v, abs((v - lag(v) OVER (PARTITION BY image, y ORDER BY x)) / 2 * 255) AS d FROM px) SELECT image, round(CASE WHEN stddev_pop(v) < 1 THEN 0 ELSE avg(d) / stddev_pop(v) END, 6) AS density FROM n GROUP BY image")
def edge_density(spark, d):
    return raster.edge_density(_px(spark, d).withColumn("v", (F.col("v") + 1) / 2 * 255)).select("image", F.round("density", 6).alias("density"))


@query("colour_bands", f"WITH {_PX} SELECT image, (y * 4 // 8)::BIGINT AS band, round(avg(v), 6) AS v FROM px GROUP BY ALL")
def colour_bands(spark, d):
    return raster.bands(_px(spark, d), 4, 8).select("image", F.col("band").cast("long").alias("band"), F.round("v", 6).alias("v"))


@query("histogram64", f"WITH {_PX} SELECT image, least(greatest(floor((v + 1) / 2 * 64), 0), 63)::BIGINT AS level, count(*)::BIGINT AS n FROM px GROUP BY ALL")
def histogram64(spark, d):
    return raster.histogram(_px(spark, d), 64, -1.0, 1.0).select("image", F.col("level").cast("long").alias("level"), "n")


@query("area_resample", f"WITH {_PX} SELECT image, (x // 2)::BIGINT AS x, (y // 2)::BIGINT AS y, round(avg(v), 6) AS v FROM px GROUP BY ALL")
def area_resample(spark, d):
    return _long(raster.resampled(_px(spark, d), 8, 8, 4, 4), "v")


# Templates: every vector is a field of 64 pixels, labels are the collections they come from.
def _fields(spark, d, label=None):
    e = emb(spark, d)
    e = e if label is None else e.filter(F.col("label") == label)
    return e.select(F.col("vec_id").alias("field"), F.col("label"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))


_F = "f AS (SELECT vec_id AS field, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"
_MASK = """m AS (SELECT label, p, avg(v) AS mean, greatest(avg(v * v) - avg(v) * avg(v), 0) AS variance FROM f GROUP BY label, p),
 t AS (SELECT label, avg(mean) AS centre, greatest(list_sort(list(variance))[count(*)::BIGINT // 2 + 1], 1e-6) AS typical FROM m GROUP BY label),
 mask AS (SELECT label, p, mean - centre AS pattern, variance, typical / (typical + variance) AS weight FROM m JOIN t USING (label))"""


def _corr(a: str, b: str, w: str) -> str:
    n, sa, sb = f"sum({w})", f"sum({w} * {a})", f"sum({w} * {b})"
    va, vb = f"(sum({w} * {a} * {a}) - {sa} * {sa} / {n})", f"(sum({w} * {b} * {b}) - {sb} * {sb} / {n})"
    return f"CASE WHEN {va} > 1e-12 AND {vb} > 1e-12 THEN least(1.0, greatest(-1.0, (sum({w} * {a} * {b}) - {sa} * {sb} / {n}) / sqrt({va} * {vb}))) ELSE 0 END"


@query("mask_learn", f"WITH {_F} SELECT label::BIGINT AS label, p::BIGINT AS p, count(*)::BIGINT AS n, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares FROM f GROUP BY label, p")
def mask_learn(spark, d):
    return masks.learn(_fields(spark, d), "label").select(F.col("label").cast("long").alias("label"), F.col("p").cast("long").alias("p"), "n", F.round("total", 6).alias("total"), F.round("squares", 6).alias("squares"))


@query("mask_weights", f"WITH {_F}, {_MASK} SELECT label::BIGINT AS label, p::BIGINT AS p, round(pattern, 6) AS pattern, round(variance, 6) AS variance, round(weight, 5) AS weight FROM mask")
def mask_weights(spark, d):
    return masks.pattern(masks.learn(_fields(spark, d), "label"), "label").select(F.col("label").cast("long").alias("label"), F.col("p").cast("long").alias("p"), F.round("pattern", 6).alias("pattern"), F.round("variance", 6).alias("variance"), F.round("weight", 5).alias("weight"))


def _masks(spark, d):
    """The masks of all labels, learnt in one pass."""
    return masks.pattern(masks.learn(_fields(spark, d), "label"), "label").select(F.col("label").cast("long").alias("mask"), "p", "pattern", "weight")


_VALUES = f"val AS (SELECT f.field, mask.label AS mask, {_corr('pattern', 'v', 'weight')} AS value FROM f JOIN mask ON f.p = mask.p GROUP BY f.field, mask.label)"


@query("mask_correlation", f"WITH {_F}, {_MASK}, {_VALUES} SELECT field, mask::BIGINT AS mask, round(value, 5) AS value FROM val")
def mask_correlation(spark, d):
    return masks.match(_fields(spark, d), _masks(spark, d)).select("field", "mask", F.round("value", 5).alias("value"))


@query("mask_best_match", f"WITH {_F}, {_MASK}, {_VALUES} SELECT field, mask::BIGINT AS mask, round(value, 5) AS value, value >= th AS hit FROM (SELECT *, 0.1 + 0.05 * mask AS th, row_number() OVER (PARTITION BY field ORDER BY value / (0.1 + 0.05 * mask) DESC, mask) AS r FROM val) WHERE r = 1")
def mask_best_match(spark, d):
    th = emb(spark, d).select(F.col("label").cast("long").alias("mask")).distinct().withColumn("threshold", 0.1 + F.lit(0.05) * F.col("mask"))
    out = masks.best_match(masks.match(_fields(spark, d), _masks(spark, d)), th)
    return out.select("field", "mask", F.round("value", 5).alias("value"), "hit")


@query("mask_assign_share", f"WITH {_F}, {_MASK}, {_VALUES} SELECT mask::BIGINT AS mask, round(avg(CASE WHEN value >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN value >= 0.1 THEN 1.0 ELSE 0.0 END) >= 0.6 AS assigned FROM val GROUP BY mask")
def mask_assign_share(spark, d):
    share = F.avg((F.col("value") >= 0.1).cast("double"))
    return masks.match(_fields(spark, d), _masks(spark, d)).groupBy("mask").agg(F.round(share, 6).alias("share"), (share >= 0.6).alias("assigned"))


_LOO = f"""{_F}, s AS (SELECT field, label, p, v, count(*) OVER w - 1 AS n, sum(v) OVER w - v AS total, sum(v * v) OVER w - v * v AS squares FROM f WINDOW w AS (PARTITION BY label, p)),
 a AS (SELECT field, label, p, v, total / n AS mean, greatest(squares / n - (total / n) * (total / n), 0) AS variance FROM s),
 b AS (SELECT field, greatest(list_sort(list(variance))[count(*)::BIGINT // 2 + 1], 1e-6) AS typical, avg(mean) AS centre FROM a GROUP BY field),
 c AS (SELECT a.field, label, mean - centre AS pat, v, typical / (typical + variance) AS wt FROM a JOIN b USING (field)), loo AS (SELECT field, label, {_corr('pat', 'v', 'wt')} AS value FROM c GROUP BY field, label)"""


@query("mask_leave_one_out", f"WITH {_LOO} SELECT label::BIGINT AS label, field, round(value, 5) AS value FROM loo")
def mask_leave_one_out(spark, d):
    return masks.leave_one_out(_fields(spark, d), "label").select(F.col("label").cast("long").alias("label"), "field", F.round("value", 5).alias("value"))


@query("mask_loo_threshold", f"WITH {_LOO}, l AS (SELECT label, list_sort(list(value)) AS s FROM loo GROUP BY label) SELECT label::BIGINT AS label, round(least(0.9, greatest(0.10, s[floor(len(s) * 0.10)::BIGINT + 1] * 0.75)), 5) AS threshold, round(s[len(s) // 2 + 1], 5) AS separability FROM l")
def mask_loo_threshold(spark, d):
    return masks.threshold(masks.leave_one_out(_fields(spark, d), "label"), "label").select(F.col("label").cast("long").alias("label"), F.round("threshold", 5).alias("threshold"), F.round("separability", 5).alias("separability"))


@query("mask_extend", f"WITH {_F} SELECT p::BIGINT AS p, count(*)::BIGINT AS n, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares FROM f GROUP BY p")
def mask_extend(spark, d):
    """Masks of all labels, learnt apart, as one."""
    learnt = masks.learn(_fields(spark, d), "label")
    out = masks.extend(learnt.filter("label % 2 = 0").drop("label"), learnt.filter("label % 2 = 1").drop("label"))
    return out.select(F.col("p").cast("long").alias("p"), "n", F.round("total", 6).alias("total"), F.round("squares", 6).alias("squares"))


_GATE = "SELECT vec_id, (vec_id % 40 + 1) / 100.0 AS o, (vec_id % 37 + 1) / 100.0 AS n FROM embeddings"


@query("mask_gate", f"SELECT vec_id, CASE WHEN o >= 0.15 AND n < 0.15 THEN false ELSE n / (o * sqrt(10 / 20.0)) >= 0.75 END AS accepted FROM ({_GATE.replace('/ 100.0', '::DOUBLE / 100')})")
def mask_gate(spark, d):
    o, n = (F.col("vec_id") % 40 + 1) / F.lit(100.0), (F.col("vec_id") % 37 + 1) / F.lit(100.0)
    return emb(spark, d).select("vec_id", masks.gate(o, F.lit(10.0), n, F.lit(20.0)).alias("accepted"))


@query("mask_largest_gap", f"WITH {_LOO}, o AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY label) AS n, lead(value) OVER (PARTITION BY label ORDER BY value) AS nx FROM loo) SELECT label::BIGINT AS label, round(nx - value, 5) AS gap, round((nx + value) / 2, 5) AS cut, (i + 1)::BIGINT AS below FROM o WHERE i >= floor(n * 0.10) AND i <= floor(n * 0.9) - 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY nx - value DESC, i) = 1")
def mask_largest_gap(spark, d):
    return masks.largest_gap(masks.leave_one_out(_fields(spark, d), "label"), "label").select(F.col("label").cast("long").alias("label"), F.round("gap", 5).alias("gap"), F.round("cut", 5).alias("cut"), "below")


@query("mask_images_needed", "SELECT vec_id, CASE WHEN x <= 1000 THEN (CASE WHEN x <= 100 THEN ceil(x / 10) * 10 ELSE ceil(x / 50) * 50 END)::BIGINT END AS needed FROM (SELECT vec_id, 20 * pow(0.15 / ((vec_id % 30 + 1)::DOUBLE / 100), 2.0) AS x FROM embeddings)")
def mask_images_needed(spark, d):
    return emb(spark, d).select("vec_id", masks.images_needed((F.col("vec_id") % 30 + 1) / F.lit(100.0), F.lit(20.0)).alias("needed"))


@query("mask_best_area", f"WITH {_F}, {_MASK}, st AS (SELECT label, stddev_pop(pattern * weight) AS s, avg(weight) AS w FROM mask GROUP BY label) SELECT label::BIGINT AS area, round(s, 6) AS strength, round(w, 5) AS stable FROM st ORDER BY s DESC, label LIMIT 1")
def mask_best_area(spark, d):
    m = _masks(spark, d)
    st = m.groupBy("mask").agg(F.stddev_pop(F.col("pattern") * F.col("weight")).alias("strength"), F.avg("weight").alias("stable"))
    best = st.agg(F.max(F.struct("strength", (-F.col("mask")).alias("neg"), "stable")).alias("b"))
    return best.select((-F.col("b.neg")).alias("area"), F.round("b.strength", 6).alias("strength"), F.round("b.stable", 5).alias("stable"))


@query("folder_check", f"WITH {_F}, {_MASK}, {_VALUES} SELECT field, mask::BIGINT AS mask, round(value, 5) AS value, value >= th AS visible, field % 5 = 0 AS metadata FROM (SELECT *, 0.1 + 0.05 * mask AS th, row_number() OVER (PARTITION BY field ORDER BY value / (0.1 + 0.05 * mask) DESC, mask) AS r FROM val WHERE mask % 3 <> 2) WHERE r = 1")
def folder_check(spark, d):
    mask = F.col("mask")
    measured = emb(spark, d).select(F.col("label").cast("long").alias("mask")).distinct().select("mask", (0.1 + F.lit(0.05) * mask).alias("threshold"), F.when(mask % 3 != 2, 0.2).alias("separability"))
    hints = emb(spark, d).filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("field"))  # what metadata say of images
    out = masks.folder_check(masks.match(_fields(spark, d), _masks(spark, d)), measured, hints)
    return out.select("field", "mask", F.round("value", 5).alias("value"), "visible", "metadata")


@query("mask_split")
def mask_split(spark, d):
    return masks.split(_fields(spark, d).select("field", "p", "v"))


@query("mask_contribution", f"""WITH {_F}, {_MASK}, {_VALUES}, b AS (SELECT f.field, mask.label AS mask, f.p, pattern AS a, v, weight AS w FROM f JOIN mask ON f.p = mask.p),
 s AS (SELECT field, mask, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * v) / sum(w) AS mv FROM b GROUP BY ALL),
 q AS (SELECT field, mask, sqrt(sum(w * (a - ma) * (a - ma))) * sqrt(sum(w * (v - mv) * (v - mv))) AS d FROM b JOIN s USING (field, mask) GROUP BY ALL),
 c AS (SELECT field, mask, p, w * (a - ma) * (v - mv) / d AS share FROM b JOIN s USING (field, mask) JOIN q USING (field, mask) WHERE d >= 1e-9)
 SELECT field, mask::BIGINT AS mask, round(max(share), 6) AS most, (count(*) FILTER (share > 0))::BIGINT AS helping, round(sum(share), 6) AS total FROM c GROUP BY field, mask""")
def mask_contribution(spark, d):
    """What the pixels add to each correlation: the most of one pixel, how many help, and their sum, which is the correlation."""
    shares = masks.contributions(_fields(spark, d), _masks(spark, d))
    out = shares.groupBy("field", "mask").agg(F.max("share").alias("most"), F.count_if(F.col("share") > 0).alias("helping"), F.sum("share").alias("total"))
    return out.select("field", "mask", F.round("most", 6).alias("most"), "helping", F.round("total", 6).alias("total"))


# A catalogue learnt from two thirds of each label's vectors, and folders of the others. Labels of one remainder by three have one mode and bear the same
# planted mark, from none to strong by their remainder by four.
_CATALOGUE = f"""{_F.replace('f AS', 'f0 AS').replace('label,', 'label, label % 3 AS mode, vec_id % 3 = 2 AS fresh,')},
 f AS (SELECT field, label, mode, fresh, p, v + (label % 4) * 0.03::DOUBLE * sin((label % 3 + 1) * (p + 1)) AS v FROM f0),
 s AS (SELECT field, label, p, v, count(*) OVER w - 1 AS n, sum(v) OVER w - v AS total, sum(v * v) OVER w - v * v AS squares FROM f WHERE NOT fresh WINDOW w AS (PARTITION BY label, p)),
 a AS (SELECT field, label, p, v, total / n AS mean, greatest(squares / n - (total / n) * (total / n), 0) AS variance FROM s),
 b AS (SELECT field, greatest(list_sort(list(variance))[count(*)::BIGINT // 2 + 1], 1e-6) AS typical, avg(mean) AS centre FROM a GROUP BY field),
 c AS (SELECT a.field, label, mean - centre AS pat, v, typical / (typical + variance) AS wt FROM a JOIN b USING (field)), loo AS (SELECT field, label, {_corr('pat', 'v', 'wt')} AS value FROM c GROUP BY field, label),
 l AS (SELECT label, list_sort(list(value)) AS s FROM loo GROUP BY label),
 cat AS (SELECT label, label % 3 AS mode, (SELECT count(DISTINCT field) FROM f WHERE NOT fresh AND f.label = l.label) AS n, least(0.9, greatest(0.10, s[floor(len(s) * 0.10)::BIGINT + 1] * 0.75)) AS threshold, s[len(s) // 2 + 1] AS sep FROM l),
 sums AS (SELECT label, p, sum(v) AS total, sum(v * v) AS squares FROM f WHERE NOT fresh GROUP BY ALL),
 m AS (SELECT label, p, total / n AS mean, greatest(squares / n - (total / n) * (total / n), 0) AS variance FROM sums JOIN cat USING (label)),
 t AS (SELECT label, avg(mean) AS centre, greatest(list_sort(list(variance))[count(*)::BIGINT // 2 + 1], 1e-6) AS typical FROM m GROUP BY label),
 mask AS (SELECT label, p, mean - centre AS pattern, typical / (typical + variance) AS weight FROM m JOIN t USING (label)),
 fold AS (SELECT label AS folder, mode, count(DISTINCT field) AS k FROM f WHERE fresh GROUP BY ALL HAVING count(DISTINCT field) >= 5),
 pairs AS (SELECT folder, cat.label AS mask, fold.mode, k, cat.n AS old_n, threshold, sep FROM fold JOIN cat ON cat.mode = fold.mode),
 val AS (SELECT q.folder, q.mask, f.field, {_corr('pattern', 'v', 'weight')} AS value FROM pairs q JOIN f ON f.label = q.folder AND f.fresh JOIN mask ON mask.label = q.mask AND mask.p = f.p WHERE sep >= 0.15 GROUP BY ALL),
 shares AS (SELECT folder, mask, avg(CASE WHEN value >= threshold THEN 1.0 ELSE 0.0 END) AS worth FROM val JOIN pairs USING (folder, mask) GROUP BY ALL HAVING avg(CASE WHEN value >= threshold THEN 1.0 ELSE 0.0 END) >= 0.6),
 fs AS (SELECT label AS folder, p, sum(v) AS total, sum(v * v) AS squares FROM f WHERE fresh GROUP BY ALL),
 g AS (SELECT q.folder, q.mask, f.field, f.p, v, old_n + k - 1 AS n, fs.total + sums.total - v AS total, fs.squares + sums.squares - v * v AS squares
  FROM pairs q JOIN f ON f.label = q.folder AND f.fresh JOIN fs ON fs.folder = q.folder AND fs.p = f.p JOIN sums ON sums.label = q.mask AND sums.p = f.p WHERE sep < 0.15 AND sep > 0),
 ga AS (SELECT folder, mask, field, p, v, total / n AS mean, greatest(squares / n - (total / n) * (total / n), 0) AS variance FROM g),
 gb AS (SELECT folder, mask, field, greatest(list_sort(list(variance))[count(*)::BIGINT // 2 + 1], 1e-6) AS typical, avg(mean) AS centre FROM ga GROUP BY ALL),
 gc AS (SELECT folder, mask, field, mean - centre AS pat, v, typical / (typical + variance) AS wt FROM ga JOIN gb USING (folder, mask, field)),
 gl AS (SELECT folder, mask, field, {_corr('pat', 'v', 'wt')} AS value FROM gc GROUP BY ALL),
 gain AS (SELECT folder, mask, list_sort(list(value))[count(*)::BIGINT // 2 + 1] AS worth FROM gl GROUP BY ALL),
 ways AS (SELECT folder, mask, 'share' AS way, worth, NULL::BOOLEAN AS accepted FROM shares UNION ALL SELECT folder, mask, 'gain', worth, worth / (sep * sqrt(old_n / (old_n + k))) >= 0.75 FROM gain JOIN pairs USING (folder, mask) WHERE worth > 0)"""


def _catalogue(spark, d):
    """(masks, sums, fields of the folders)."""
    mark = (F.col("label") % 4) * F.lit(0.03) * F.sin((F.col("label") % 3 + 1) * (F.col("p") + 1))
    f = _fields(spark, d).withColumn("mode", F.col("label") % 3).withColumn("area", F.lit(0)).withColumn("v", F.col("v") + mark)
    old, fresh = f.filter("field % 3 <> 2"), f.filter("field % 3 = 2").withColumnRenamed("label", "folder")
    sums = masks.learn(old, "label").withColumnRenamed("label", "mask")
    measured = masks.threshold(masks.leave_one_out(old, "label"), "label").withColumnRenamed("label", "mask")
    known = measured.join(sums.filter("p = 0").select("mask", "n"), "mask").select("mask", (F.col("mask") % 3).alias("mode"), F.lit(0).alias("area"), "n", "threshold", "separability")
    return known, sums.drop("n"), fresh


@query("mask_assignment", f"WITH {_CATALOGUE} SELECT folder::BIGINT AS folder, mask::BIGINT AS mask, way, round(worth, 5) AS worth, accepted FROM ways QUALIFY row_number() OVER (PARTITION BY folder ORDER BY way DESC, worth DESC, mask) = 1")
def mask_assignment(spark, d):
    known, sums, fresh = _catalogue(spark, d)
    out = masks.assigned(fresh, known, sums)
    return out.select(F.col("folder").cast("long").alias("folder"), F.col("mask").cast("long").alias("mask"), "way", F.round("worth", 5).alias("worth"), "accepted")


def _grid(n: int, old: int = 8) -> str:
    """SQL of the bilinear picture of n x n values: (image, x, y, v)."""
    at = lambda c: f"{c} * {old - 1}::DOUBLE / {n - 1}"
    return f"""g{n} AS (SELECT image, x, y, t + (b - t) * fy AS v FROM (SELECT p.image, c.x, c.y, c.fy,
  sum(p.v * (CASE p.x WHEN c.x0 THEN 1 - c.fx ELSE 0 END + CASE p.x WHEN c.x1 THEN c.fx ELSE 0 END)) FILTER (p.y = c.y0) AS t,
  sum(p.v * (CASE p.x WHEN c.x0 THEN 1 - c.fx ELSE 0 END + CASE p.x WHEN c.x1 THEN c.fx ELSE 0 END)) FILTER (p.y = c.y1) AS b
  FROM (SELECT x, y, least(floor({at('x')}), {old - 1})::BIGINT AS x0, least(floor({at('x')}) + 1, {old - 1})::BIGINT AS x1, {at('x')} - floor({at('x')}) AS fx,
    least(floor({at('y')}), {old - 1})::BIGINT AS y0, least(floor({at('y')}) + 1, {old - 1})::BIGINT AS y1, {at('y')} - floor({at('y')}) AS fy FROM range({n}) a(x), range({n}) b(y)) c
  JOIN px p ON p.x IN (c.x0, c.x1) AND p.y IN (c.y0, c.y1) GROUP BY p.image, c.x, c.y, c.fy))"""


def _pictures(spark, d, n=24):
    return emb(spark, d).select(F.col("vec_id").alias("image"), raster.bilinear(F.col("embedding").cast("array<double>"), 8, 8, n, n).alias("values"))


@query("bilinear_resample", f"WITH {_PX}, {_grid(24)} SELECT image, x::BIGINT AS x, y::BIGINT AS y, round(v, 6) AS v FROM g24")
def bilinear_resample(spark, d):
    px = _pictures(spark, d).select("image", F.posexplode("values").alias("p", "v"))
    return _long(px.select("image", (F.col("p") % 24).alias("x"), F.floor(F.col("p") / 24).alias("y"), "v"), "v")


@query("heat_map", f"""WITH {_PX}, {_grid(24)}, {_grid(6)}, q AS (SELECT x, y, v / sqrt(sum(v * v) OVER ()) AS v FROM g6 WHERE image = 0)
 SELECT g.image, (g.y // 6)::BIGINT AS row, (g.x // 6)::BIGINT AS col, round(sum(g.v * q.v) / sqrt(sum(g.v * g.v)), 5) AS score FROM g24 g JOIN q ON q.x = g.x % 6 AND q.y = g.y % 6 GROUP BY ALL""")
def heat_map(spark, d):
    """Sixteen windows of each picture against the whole picture of vector 0."""
    asked = _pictures(spark, d, 6).filter("image = 0").select(normalised(F.col("values")).alias("q")).limit(1)
    score = lambda c: F.aggregate(F.zip_with(normalised(c), F.col("q"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    out = _pictures(spark, d).crossJoin(F.broadcast(asked)).select("image", F.explode(raster.heat_map(F.col("values"), 24, 24, score)).alias("w"))
    return out.select("image", F.col("w.row").cast("long").alias("row"), F.col("w.col").cast("long").alias("col"), F.round("w.score", 5).alias("score"))


@query("field_crops", f"""WITH {_PX}, {_grid(24)}, w(area, x0, y0) AS (VALUES (0, 7, 7), (1, 0, 0), (2, 14, 0), (3, 0, 14), (4, 14, 14))
 SELECT image, area::BIGINT AS area, round(avg(v), 6) AS mean, round(max(v), 6) AS most, count(*)::BIGINT AS n FROM g24 JOIN w ON x BETWEEN x0 AND x0 + 9 AND y BETWEEN y0 AND y0 + 9 GROUP BY image, area""")
def field_crops(spark, d):
    """The five windows of 45 % of each picture's side."""
    out = _pictures(spark, d).select("image", F.explode(raster.crops(F.col("values"), 24, 24)).alias("c")).select("image", F.col("c.area").cast("long").alias("area"), F.explode("c.values").alias("v"))
    return out.groupBy("image", "area").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"), F.count(F.lit(1)).alias("n"))


@query("colour_bands_carried", f"""WITH {_PX}, c AS (SELECT image, x, y, floor((v + 1) / 2 * 255) AS g, CASE WHEN image % 3 = 0 AND y // 2 = image % 4 THEN 0 ELSE (x * 31 + image) % 256 END AS a FROM px),
 b AS (SELECT image, (y // 2)::BIGINT AS band, sum(g * a) / nullif(sum(a), 0) AS r FROM c GROUP BY ALL)
 SELECT image, band, floor(last_value(r IGNORE NULLS) OVER (PARTITION BY image ORDER BY band))::BIGINT AS r FROM b""")
def colour_bands_carried(spark, d):
    """Grey pictures with a planted opacity, wholly clear in one band of every third picture."""
    clear = (F.col("image") % 3 == 0) & (F.floor(F.col("y") / 2) == F.col("image") % 4)
    level = F.floor((F.col("v") + 1) / 2 * 255)
    px = _px(spark, d).select("image", "y", level.alias("r"), level.alias("g"), level.alias("b"), F.when(clear, 0).otherwise((F.col("x") * 31 + F.col("image")) % 256).alias("a"))
    return raster.colour_bands(px, 4, 8).select("image", F.col("band").cast("long").alias("band"), "r")


@query("network_input", f"""WITH {_PX}, {_grid(12)}, k(c, mul, m, s) AS (VALUES (0, 1.0, 0.48145466, 0.26862954), (1, -1.0, 0.4578275, 0.26130258), (2, 0.5, 0.40821073, 0.27577711)),
 b AS (SELECT image, x, y, c, (floor((v * mul::DOUBLE + 1) / 2 * 255 + 0.5) / 255 - m::DOUBLE) / s::DOUBLE AS v FROM g12, k) SELECT image, c::BIGINT AS channel, round(avg(v), 5) AS mean, round(max(v), 5) AS most, count(*)::BIGINT AS n FROM b GROUP BY ALL""")
def network_input(spark, d):
    """Pictures of three channels made of a vector, on a grid of 12 x 12."""
    plane = lambda f: F.transform(F.col("embedding").cast("array<double>"), lambda v: (v * f + 1) / 2 * 255)
    out = emb(spark, d).select(F.col("vec_id").alias("image"), F.posexplode(raster.network_input([plane(1.0), plane(-1.0), plane(0.5)], 8, 8, 12)).alias("p", "v"))
    return out.groupBy("image", F.floor(F.col("p") / 144).alias("channel")).agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.max("v"), 5).alias("most"), F.count(F.lit(1)).alias("n"))


@query("grey_last_row", f"WITH {_PX} SELECT image, (count(*) FILTER (image % 3 = 0 AND x <> image % 9 OR floor((v + 1) / 2 * 255) = 128)) > 7 AS grey FROM px WHERE y = 7 GROUP BY image")
def grey_last_row(spark, d):
    """Pictures whose last row is planted grey in every third, but for one pixel."""
    planted = (F.col("image") % 3 == 0) & (F.col("y") == 7) & (F.col("x") != F.col("image") % 9)
    level = F.when(planted, 128).otherwise(F.floor((F.col("v") + 1) / 2 * 255))
    px = _px(spark, d).select("image", F.lit(8).alias("width"), F.lit(8).alias("height"), "x", "y", level.alias("r"), level.alias("g"), level.alias("b"))
    return raster.has_grey_last_row(px)


@query("mask_high_share", f"WITH {_F}, {_MASK}, {_VALUES}, l AS (SELECT mask, list_sort(list(value)) AS s FROM val WHERE value > 0 GROUP BY mask) SELECT mask::BIGINT AS mask, round(s[least(floor(len(s) * 0.98::DOUBLE), len(s) - 1)::BIGINT + 1], 5) AS value FROM l")
def mask_high_share(spark, d):
    values = masks.match(_fields(spark, d), _masks(spark, d)).select("mask", "value")
    return masks.high_share(values, "mask").select("mask", F.round("value", 5).alias("value"))


@query("mask_catalogue_sums", f"WITH {_CATALOGUE} SELECT count(*)::BIGINT AS masks, sum(n)::BIGINT AS fields, count(*) FILTER (sep >= 0.15)::BIGINT AS proven FROM cat")
def mask_catalogue_sums(spark, d):
    return masks.catalogue_sums(_catalogue(spark, d)[0])
