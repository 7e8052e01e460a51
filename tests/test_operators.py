import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import formats, text, vectors
from pixelloom.operators import calibration, components, dedup, incremental, lists, masks, pairs, pictures, preference, rating, raster, search, tagging


def one(spark, col, row="1 as x"):
    return spark.sql(f"select {row}").select(col.alias("v")).first()["v"]


def test_similarity_of_three_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.score for r in search.with_similarity(df, df.filter("vec_id = 0")).collect()}
    assert out == pytest.approx({0: 1.0, 1: 0.6, 2: 0.0})
    assert search.with_similarity(df, df.filter("vec_id = 9")).count() == 0


def test_chain_needs_neighbour_and_anchor(spark):
    at = lambda a: [math.cos(a), math.sin(a)]
    df = spark.createDataFrame([(0, at(0.0)), (1, at(0.4)), (2, at(0.8)), (3, at(1.5))], "vec_id long, embedding array<double>")
    near = {r.vec_id for r in search.chain(df, df.filter("vec_id = 0"), 0.9, 0.6).collect()}
    assert near == {0, 1, 2}
    assert {r.vec_id for r in search.chain(df, df.filter("vec_id = 0"), 0.9, 0.8).collect()} == {0, 1}


def test_components_equal_transitive_closure(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in out} == {v: root(v) for v in parent}


@pytest.mark.parametrize("most", [3, 20])
def test_hamming_pairs_by_bands_and_blocks(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, 12)
    values = [int(b) ^ int(m) for b in base for m in (0, 1, 0b1011, 0x7FFF00)]
    rows = list(enumerate(values))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= most}
    got = {(r.a, r.b) for r in pairs.hamming_pairs(spark.createDataFrame(rows, "vec_id long, hash long"), most).collect()}
    assert got == want


@pytest.mark.parametrize(("spread", "least"), [(0.05, 0.98), (0.4, 0.9), (3.0, 0.3)])
def test_cosine_pairs_by_cells(spark, monkeypatch, spread, least):
    """Clustered and even vectors, of unit norm and not, with copies: all pairs are found, and few rows are copied where vectors cluster."""
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 12)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(10, 8))[rng.integers(0, 10, 150)] + spread * rng.normal(size=(150, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True) * (1 if spread < 3 else rng.uniform(0.9, 1.1, (150, 1)))
    v[140:] = v[0]
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (900, None), (None, [1.0] * 8)], "vec_id long, embedding array<double>").repartition(3)
    s = v @ v.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= least}
    got = [(r.a, r.b) for r in pairs.cosine_pairs(df, least).collect()]
    assert len(got) == len(set(got)) and {p for p in set(got) ^ want if abs(s[p] - least) > 1e-9} == set() and len(want) > 40
    groups = {r.id: r.component for r in components.connected_components(pairs.cosine_pairs(df, least)).collect()}
    assert {r.id: r.component for r in components.connected_components(pairs.cosine_links(df, least)).collect()} == groups
    if spread < 0.1:
        rows = [pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(v.tolist())], names=["k", "v"])]
        assert sum(b.num_rows for b in pairs._placed(v[:13], 2 * math.sqrt(2 - 2 * least))(rows)) < 3 * 150


def test_hamming_links_hold_the_groups(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.choice([0, 1, 3, 255, 2**40, 2**40 + 1])) for i in range(60)] + [(99, 2**50 + 2**30 + 7 * 2**9)], "vec_id long, hash long")
    part = lambda e: {r.id: r.component for r in components.connected_components(e).collect()}
    assert part(pairs.hamming_links(df, 1)) == part(pairs.hamming_pairs(df, 1)) and pairs.hamming_links(df, 1).count() < 70


def test_formats(spark):
    rows = [
        ("jpg", "FFD8FF0000FFD9", "jpeg", True), ("jpg", "FFD8FF0000", "jpeg", False), ("png", "FFD8FF0000FFD9", "jpeg", False),
        ("png", "89504E470D0A1A0A0000000049454E44AE426082", "png", True), ("gif", "4749463839610000003B", "gif", True),
        ("bmp", "424D0A000000000000000000", "bmp", True), ("bmp", "424DFF000000000000000000", "bmp", False),
        ("webp", "524946460D00000057454250565038200000000000", "webp", True), ("tif", "49492A0008000000", "tiff", True),
        ("ico", "000001000100" + "00" * 16, "ico", True), ("jpg", "", None, False), ("dat", "0011", None, False),
    ]
    df = spark.createDataFrame([(i, e, h) for i, (e, h, _, _) in enumerate(rows)], "i int, e string, h string")
    out = df.select("i", formats.checked(F.unhex("h"), F.col("e")).alias("c")).orderBy("i").collect()
    assert [(r.c.format, r.c.ok) for r in out] == [(f, ok) for _, _, f, ok in rows]


def test_texts(spark):
    assert one(spark, text.snippet(F.lit("x" * 40 + "Needle" + "y" * 40), "needle")) == "…" + "x" * 25 + "Needle" + "y" * 25 + "…"
    assert one(spark, text.snippet(F.lit("needle\nb"), "needle")) == "needle b"
    names = ["b10", "b9", "A2", "a1", "b9x", "99999999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["99999999999", "a1", "A2", "b9", "b9x", "b10"]
    phrases = F.create_map(*map(F.lit, ["two people", "zwei leute", "on the beach", "am strand", "dog", "hund"]))
    tokens = text.query_tokens(F.lit("Two people, on the beach dogs!"))
    assert one(spark, text.terms_translated(tokens, phrases)) == "zwei leute am strand hund"
    assert one(spark, text.stem(F.lit("dogs"), phrases)) == "hund"
    assert one(spark, text.readable_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, text.new_lines(F.lit("Alpha\nbeta"), F.lit("BETA\nNew\n new \nother"))) == ["New", "other"]


def test_masks_merge_and_leave_one_out(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(7, 5))
    rows = [(i, p, float(v[i, p])) for i in range(7) for p in range(5)]
    df = spark.createDataFrame(rows, "field long, p int, v double")
    whole = {r.p: (r.n, r.total) for r in masks.learn(df).collect()}
    parts = masks.extend(masks.learn(df.filter("field < 3")), masks.learn(df.filter("field >= 3")))
    assert {r.p: (r.n, pytest.approx(r.total)) for r in parts.collect()} == whole
    others = np.delete(v, 2, axis=0)
    mean, var = others.mean(0), others.var(0)
    typ = max(sorted(var)[2], 1e-6)
    w, a, b = typ / (typ + var), mean - mean.mean(), v[2]
    ma, mb = np.average(a, weights=w), np.average(b, weights=w)
    want = (w * (a - ma) * (b - mb)).sum() / math.sqrt((w * (a - ma) ** 2).sum() * (w * (b - mb) ** 2).sum())
    got = {r.field: r.value for r in masks.leave_one_out(df).collect()}
    assert got[2] == pytest.approx(want)


def test_ridge_and_calibration(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 2 == 1) for i in range(30)], "vec_id long, embedding array<double>, bad boolean")
    d = v[1::2].mean(0) - v[::2].mean(0)
    d /= np.linalg.norm(d)
    c = sum(x.T @ x / len(x) for x in (v[::2], v[1::2]))
    assert preference.ridge_direction(df) == pytest.approx(np.linalg.solve(c + 0.003 * np.eye(4), d))
    assert preference.ridge_direction(df.limit(0)) is None
    mean, pcs = calibration.fit(df, 2)
    x = v - v.mean(0)
    _, vectors_ = np.linalg.eigh(x.T @ x / 30)
    assert np.abs(pcs @ vectors_[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-6)
    y = x - x @ pcs.T @ pcs
    got = np.array([r.e for r in df.select(calibration.applied(F.col("embedding"), mean, pcs).alias("e"), "vec_id").orderBy("vec_id").collect()])
    assert got == pytest.approx(y / np.linalg.norm(y, axis=1, keepdims=True))
    assert calibration.fit(df.limit(2), 1) is None


def test_folder_vector_blends_own_and_pooled(spark):
    rng = np.random.default_rng(14)
    v = rng.normal(size=(60, 4))
    rows = [(i, i % 3, v[i].tolist(), i % 2 == 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, folder long, embedding array<double>, bad boolean")
    sums = preference.side_sums(df, "folder")
    own = df.filter("folder = 1")
    unit = lambda x: x / np.linalg.norm(x)
    rest = v[[i for i in range(60) if i % 3 != 1 and i % 2]].mean(0) - v[[i for i in range(60) if i % 3 != 1 and not i % 2]].mean(0)
    want = 10 / 15 * unit(preference.ridge_direction(own)) + 5 / 15 * unit(rest)  # ten on the smaller side
    assert preference.folder_vector(own, sums, 1) == pytest.approx(want)
    few = df.filter("folder <> 1 or vec_id < 10")  # too few of its own: the others alone
    got = preference.folder_vector(few.filter("folder = 1"), preference.side_sums(few, "folder"), 1)
    assert unit(got) == pytest.approx(unit(rest))
    assert preference.folder_vector(own.limit(2), preference.side_sums(own.limit(2), "folder"), 1) is None


def test_folders_that_hold_the_same(spark):
    cols = "id long, place string, content string"
    left = spark.createDataFrame([(1, "a/x", "A"), (2, "b/y", "B"), (3, "C", "A")], cols)
    right = spark.createDataFrame([(11, "A/X", "A"), (12, "q", "B"), (13, "c", "A")], cols)
    row = lambda l, r: dedup.folder_comparison(l, r).first().asDict()
    assert row(left, right) == {"lefts": 3, "rights": 3, "without_partner": 0, "matched": 3, "right_only": 0, "unreadable": 0, "equal": True, "same_places": False}
    assert row(left, left)["same_places"] and row(left, left)["equal"]
    lost = right.withColumn("content", F.when(F.col("id") < 13, F.col("content")))
    assert row(left, lost) == {"lefts": 3, "rights": 3, "without_partner": 0, "matched": 2, "right_only": 1, "unreadable": 1, "equal": False, "same_places": False}
    assert not row(left.limit(0), right.limit(0))["equal"]


def test_cyclic_similarity_ignores_shifts(spark):
    v = [1.0, 0.0, 0.0, 0.5]
    assert one(spark, vectors.cyclic_similarity(F.array(*map(F.lit, v)), F.array(*map(F.lit, v[2:] + v[:2])), 4)) == pytest.approx(1.25)


def test_rating_and_lists(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(12)] + [("b", 1.0)], "folder string, v double")
    out = rating.rated(df, "folder", "v", 0.5).collect()
    assert {r.v: r.bad for r in out if r.folder == "a"} == {0.0: None} | {float(i): i < 3 for i in range(1, 12)}
    assert [r.bad for r in out if r.folder == "b"] == [None]
    names = spark.createDataFrame([("f2",), ("f10",), ("f1",)], "name string")
    assert [lists.next_in_order(names, a).first()["next_name"] for a in ("f2", "f10")] == ["f10", "f10"]


def test_raster_edges(spark):
    rows = [(0, y * 4 + x, 1.0 if x >= 2 else 0.0) for y in range(4) for x in range(4)]
    px = spark.createDataFrame([(i, p % 4, p // 4, v) for i, p, v in rows], "image int, x int, y int, v double")
    out = raster.sobel(px).collect()
    assert {(r.x, r.y, r.magnitude, r.orientation) for r in out} == {(x, y, 4.0, 0.0) for x in (1, 2) for y in (1, 2)}


def test_pictures_equal_pixels(spark):
    """Filters over whole pictures give what the windows over pixels give; damaged and small pictures."""
    rng = np.random.default_rng(17)
    shapes = [(5, 4), (5, 4), (3, 3), (8, 2), (1, 6)]
    rows = [(i, w, h, rng.normal(size=w * h).tolist()) for i, (w, h) in enumerate(shapes)]
    odd = [(7, 2, 2, [1.0]), (8, 2, 1, [None, 1.0]), (9, 0, 0, []), (10, 2, 2, None), (11, 4, 4, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "image long, width int, height int, values array<double>").repartition(2)
    px = spark.createDataFrame([(i, p % w, p // w, v) for i, w, _, vs in [*rows, odd[-1]] for p, v in enumerate(vs)], "image long, x int, y int, v double")
    shown = lambda d, *cols: sorted((r.image, r.x, r.y, *(round(r[c], 9) + 0.0 for c in cols)) for r in d.collect())
    for ours, theirs in ((pictures.high_pass(df, 2), raster.high_pass(px, 2)), (pictures.blurred(df), raster.blur(px))):
        assert shown(pictures.pixels(ours, "values"), "values") == shown(theirs, "v")
    assert shown(pictures.pixels(pictures.sobel(df), "magnitude", "orientation", margin=1), "magnitude", "orientation") == shown(raster.sobel(px), "magnitude", "orientation")
    got = {r.image: r.descriptor for r in pictures.shape_descriptors(df).collect()}
    want = {r.image: r.descriptor for r in raster.descriptor_array(raster.shape_descriptor(raster.sobel(px))).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 11} and all(got[k] == pytest.approx(want.get(k, [0.0] * 36)) for k in got)


@pytest.mark.parametrize("block", [100, 7])
def test_top_labels_in_blocks(spark, block):
    rng = np.random.default_rng(19)
    v, l = rng.normal(size=(40, 6)), rng.normal(size=(30, 6))
    l[20] = l[3]  # equal scores go to the smaller label
    rows = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (99, None)], "vec_id long, embedding array<double>").repartition(3)
    labels = spark.createDataFrame([*((f"l{i:02}", x.tolist()) for i, x in enumerate(l)), ("none", None)], "label string, vector array<double>")
    got = sorted((r.vec_id, r["rank"], r.label) for r in tagging.top_labels(rows, labels, 4, 0.5, block=block).collect())
    want = []
    for i, x in enumerate(v @ l.T):
        best = sorted((-round(s, 9), f"l{j:02}") for j, s in enumerate(x) if s >= 0.5)[:4]
        want += [(i, k + 1, name) for k, (_, name) in enumerate(best)]
    assert got == sorted(want) and len(want) > 80
    assert tagging.top_labels(rows, labels.limit(0), 4, 0.5).count() == 0


def test_refresh(spark):
    cols = "path string, folder string, size long, mtime long"
    index = spark.createDataFrame([("A/1", "A", 1, 1), ("a/2", "a", 1, 1), ("b/1", "b", 1, 1)], cols)
    scan = spark.createDataFrame([("a/1", "a", 1, 1), ("a/3", "a", 5, 5)], cols)
    assert {r.path for r in incremental.refreshed(scan, index, lambda d: d).collect()} == {"A/1", "b/1", "a/3"}
