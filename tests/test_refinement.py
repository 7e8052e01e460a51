"""Heads of files, byte equality by refinement, stores with a pointer, scopes, tagging again, labels of bands, shares of pixels."""

import datetime
import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import image_heads, text
from pixelloom.operators import dedup, masks, raster, retag, scope, timeline
from pixelloom.sources import files
from test_sources import png


def tiff(order, entries, camera=(), base=8):
    """A TIFF block of (tag, type, count, bytes) entries; longer values after the directories."""
    size = lambda es: 2 + 12 * len(es) + 4
    first = [*entries, *([(0x8769, 4, 1, struct.pack(order + "I", base + size(entries) + 12))] if camera else [])]
    at = base + size(first) + (size(camera) if camera else 0)
    out, tail = b"", b""
    for es in (first, camera) if camera else (first,):
        out += struct.pack(order + "H", len(es))
        for tag, kind, count, value in es:
            if len(value) > 4:
                out += struct.pack(order + "HHII", tag, kind, count, at + len(tail))
                tail += value
            else:
                out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        out += b"\0\0\0\0"
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", base) + out + tail


def jpeg(block=b"", width=30, height=20, filler=0):
    app = b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block if block else b""
    other = b"".join(b"\xff\xee" + struct.pack(">H", 60_002) + b"x" * 60_000 for _ in range(filler))
    return b"\xff\xd8" + app + other + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0\xff\xda\0\2" + b"p" * 50_000 + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_capture_fields(spark, order):
    entries = [(0x010E, 2, 8, b"A tree \0"), (0x010F, 2, 3, b"Ab\0"), (0x0131, 2, 6, "Grün\0".encode())]
    camera = [(0x829D, 5, 1, struct.pack(order + "II", 28, 10)), (0x8827, 3, 1, struct.pack(order + "H", 400)), (0x9003, 2, 20, b"2024:05:06 07:08:09\0"), (0x920A, 5, 1, struct.pack(order + "II", 1, 0))]
    block = tiff(order, entries, camera)
    lost = bytearray(block)
    lost[18:22] = struct.pack(order + "I", 2**31)  # the description lies far outside
    loop = tiff(order, entries) [:4] + struct.pack(order + "I", 2**32 - 8)
    rows = [(0, jpeg(block)), (1, block), (2, jpeg(bytes(lost))), (3, jpeg(loop)), (4, jpeg(block[:30])), (5, None), (6, b""), (7, b"\xff\xd8\xff\xe1"), (8, b"text"), (9, jpeg())]
    got = {r.i: r.f.asDict() for r in spark.createDataFrame(rows, "i int, head binary").select("i", image_heads.capture_fields(F.col("head")).alias("f")).collect()}
    none = dict.fromkeys(image_heads.FIELDS)
    whole = none | {"description": "A tree", "make": "Ab", "software": "Grün", "aperture": 2.8, "iso": 400, "taken": "2024:05:06 07:08:09"}
    assert got[0] == got[1] == whole
    assert got[2] == whole | {"description": None}
    assert all(got[i] == none for i in range(3, 10))


def test_dimensions_of_all_kinds():
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    vp8l = b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 63 | 31 << 14)
    vp8 = b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 320 | 1 << 14, 200)
    tif = tiff(">", [(256, 3, 1, struct.pack(">H", 5)), (257, 4, 1, struct.pack(">I", 6))])
    cases = [(jpeg(width=300, height=2), (300, 2)), (b"GIF89a\x05\0\x06\0", (5, 6)), (bmp, (7, 9)), (vp8x, (100, 50)), (vp8l, (64, 32)), (vp8, (320, 200)), (tif, (5, 6)), (b"\0\0\1\0\1\0\0\x20", (256, 32)), (b"none", None)]
    for data, want in cases:
        assert image_heads.dimensions(data) == want
    with pytest.raises(image_heads.Short):
        image_heads.dimensions(b"\xff\xd8\xff\xe1\xff\xff")


def test_sizes_by_heads_equal_decoded_sizes(spark, tmp_path):
    png(tmp_path / "a.png", 3, 2, (1, 2, 3))
    png(tmp_path / "b.PNG", 17, 40, (1, 2, 3))
    (tmp_path / "c.jpg").write_bytes(jpeg(width=640, height=480))
    (tmp_path / "far.jpg").write_bytes(jpeg(width=64, height=48, filler=3))
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe1\0")
    (tmp_path / "x.txt").write_text("x" * 9000)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.header_sizes(spark, str(tmp_path)).collect()}
    decoded = {r.origin.rsplit("/", 1)[1]: (r.width, r.height) for r in files.image_sizes(spark, str(tmp_path)).filter("decodes").collect()}
    assert len(got) == 6 and {k: (got[k].width, got[k].height) for k in ("a.png", "b.PNG")} == {k: decoded[k] for k in ("a.png", "b.PNG")}
    assert (got["c.jpg"].width, got["c.jpg"].height, got["c.jpg"].bytes_read) == (640, 480, 4096)
    assert (got["far.jpg"].width, got["far.jpg"].height) == (64, 48) and got["far.jpg"].bytes_read < 2**19
    assert all(got[k].width is None for k in ("bad.jpg", "x.txt"))
    heads = {r.path.rsplit("/", 1)[1]: len(r.head) for r in files.file_heads(spark, str(tmp_path), extensions=("jpg",), head=100).collect()}
    assert heads == {"c.jpg": 100, "far.jpg": 100, "bad.jpg": 5}


def test_byte_equality_reads_no_more_than_it_must(spark, tmp_path):
    rng = random.Random(2)
    long = bytes(rng.randrange(256) for _ in range(60_000))
    contents = [long, long, long[:-1] + b"!", b"?" + long[1:], long[:100], long[:100], b"", b"", b"a", b"b", long + b"x", long]
    for i, c in enumerate(contents):
        (tmp_path / f"{i:02}").write_bytes(c)
    listed = files.scan_files(spark, str(tmp_path)).select(F.col("path").alias("id"), F.col("size"))
    out, read = dedup.equal_classes(listed, files.file_blocks(), first=64, growth=8)
    name = lambda p: int(p.rsplit("/", 1)[1])
    got = sorted((name(r.id), name(r.class_id), r.members) for r in out.collect())
    assert got == [(0, 0, 3), (1, 0, 3), (4, 4, 2), (5, 4, 2), (11, 0, 3)]
    shared = [len(c) for c in contents if sum(len(c) == len(x) for x in contents) > 1]
    assert sum(read) < sum(shared) - 59_000  # the file that differs in its first byte is not read on
    table = spark.createDataFrame([(i, len(c), bytearray(c)) for i, c in enumerate(contents)], "id int, size long, content binary")
    again, same = dedup.equal_classes(table.select("id", "size"), dedup.content_blocks(table), first=64, growth=8)
    assert sorted(map(tuple, again.collect())) == sorted([*got, (6, 6, 2), (7, 6, 2)]) and same == read  # a listing has no empty files
    assert dedup.equal_classes(table.limit(0), dedup.content_blocks(table))[0].count() == 0


def test_tables_move_by_one_rename(spark, tmp_path):
    at = str(tmp_path / "t")
    assert files.current(spark, at) is None
    files.write_table(spark.range(3).toDF("x"), at)
    reader = files.read_table(spark, at)
    files.write_table(files.read_table(spark, at).union(spark.range(10, 12).toDF("x")), at)
    assert reader.count() == 3 and files.read_table(spark, at).count() == 5  # a reader that has begun still finds its version
    with pytest.raises(Exception):
        files.write_table(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), at)
    os.makedirs(f"{at}/v-half")  # what a writer leaves that dies before the rename
    assert files.read_table(spark, at).count() == 5
    for _ in range(3):
        files.write_table(spark.range(1).toDF("x"), at)
    assert files.read_table(spark, at).count() == 1 and len([n for n in os.listdir(at) if n.startswith("v-0")]) == 2


def test_masks_of_the_first_kind_are_raised_once(spark, tmp_path):
    old = {"Kante": 2, "Grundmenge": 7, "Schwelle": 0.25, "Muster": [0.5, -0.5], "Summe": [1.0, 2.0], "SummeQuadrat": [3.0, 4.0]}
    (tmp_path / "old.json").write_text(json.dumps(old, indent=1))
    at, legacy = str(tmp_path / "store"), str(tmp_path / "old.json")
    broken = files.save_store
    try:
        files.save_store = lambda *a: (_ for _ in ()).throw(OSError("full"))
        with pytest.raises(OSError):
            files.load_store(spark, "masks", at, legacy)
    finally:
        files.save_store = broken
    first = files.load_store(spark, "masks", at, legacy).collect()
    assert [(r.name, r.edge, r.n, r.mode, r.area, r.threshold, r.separability, r.pattern, r.weight, r.total) for r in first] == [("1", 2, 7, 0, 0, 0.25, None, [0.5, -0.5], None, [1.0, 2.0])]
    (tmp_path / "old.json").write_text("{nothing")
    assert files.load_store(spark, "masks", at, legacy).collect() == first
    assert files.load_store(spark, "masks", str(tmp_path / "other"), legacy).count() == 0
    assert files.load_store(spark, "masks", str(tmp_path / "third"), str(tmp_path / "nowhere.json")).count() == 0


def test_scope_has_the_own_folder_first(spark):
    known = spark.createDataFrame([("/a/b",), ("/A/B/",), ("/a/b/c",), ("/a/bc",), ("/x",), (None,)], "path string")
    rows = lambda where, home="/a/b": [(r.path.lower(), r.own) for r in scope.scope(known, home, where).orderBy(F.desc("own"), "path").collect()]
    assert rows(scope.FOLDER) == [("/a/b", True)]
    assert rows(scope.BRANCH) == [("/a/b", True), ("/a/b/c", False)]
    assert rows(scope.ALL, "/new/") == [("/new", True), ("/a/b", False), ("/a/b/c", False), ("/a/bc", False), ("/x", False)]
    with pytest.raises(ValueError):
        rows("else")


def test_scoped_search_reads_few_folders_and_finds_all(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [(i, f"/f{i % 30}", (centres[i % 30] + 0.15 * rng.normal(size=16)).tolist()) for i in range(900)]
    index = spark.createDataFrame(rows, "vec_id long, folder string, embedding array<double>")
    summary = scope.summaries(index)
    folders = scope.scope(index.select(F.col("folder").alias("path")), "/f7")
    for query in (rows[3][2], rows[7][2], rng.normal(size=16).tolist()):
        hits, read = scope.scoped_top_k(index, summary, folders, query, 12)
        q = np.array(query) / np.linalg.norm(query)
        want = sorted(((-float(np.dot(v, q) / np.linalg.norm(v)), k) for k, _, v in rows))[:12]
        assert [r.vec_id for r in hits.collect()] == [k for _, k in want]
    hits, read = scope.scoped_top_k(index, summary, folders, rows[3][2], 12)
    assert hits.count() == 12 and read.count() < 15 and read.filter("own").count() == 1
    few = scope.scoped_top_k(index.limit(5), scope.summaries(index.limit(5)), folders, query, 12)[0]
    assert few.count() == 5  # fewer rows than asked for: all are read


def test_tagging_again_writes_stale_folders_only(spark, tmp_path):
    at = str(tmp_path / "index")
    index = spark.createDataFrame([(i, "abc"[i % 3], float(i)) for i in range(12)], "vec_id long, folder string, x double").withColumn("tag", F.lit("old"))
    retag.save_tagged(index.filter("folder <> 'b'"), at, 1)
    retag.save_tagged(index.filter("folder = 'b'"), at, 2)
    parts = lambda f: sorted(n for n in os.listdir(f"{at}/folder={f}") if n.startswith("part"))
    before = {f: parts(f) for f in "abc"}
    tagged = lambda rows: rows.withColumn("tag", F.concat(F.lit("n"), F.col("x").cast("int").cast("string")))
    assert retag.retag(spark, at, tagged, 2) == 2
    assert parts("b") == before["b"] and parts("a") != before["a"] and parts("c") != before["c"]
    got = {r.vec_id: (r.folder, r.tag, r.labels_version) for r in spark.read.parquet(at).collect()}
    assert got == {i: ("abc"[i % 3], "old" if i % 3 == 1 else f"n{i}", 2) for i in range(12)}
    after = {f: parts(f) for f in "abc"}
    assert retag.retag(spark, at, tagged, 2) == 0 and {f: parts(f) for f in "abc"} == after


@pytest.mark.parametrize(("year", "month", "n"), [(2001, 1, 30), (2001, 8, 30), (2001, 9, 30), (2001, 12, 3), (2001, 10, 3), (2001, 11, 14), (2003, 3, 240)])
def test_band_labels_don_t_crowd(spark, year, month, n):
    months = [datetime.datetime(year + (month - 1 + i) // 12, (month - 1 + i) % 12 + 1, 5) for i in range(n)]
    got = timeline.month_band(spark.createDataFrame([(m,) for m in (months[0], months[-1])], "ts timestamp")).orderBy("month").collect()
    labels = [str(m.year) if i == 0 or m.month == 1 else "" for i, m in enumerate(months)]
    if any(labels[1:5]):
        labels[0] = ""
    assert [r.label or "" for r in got] == labels


def test_references_are_decoded_once(spark):
    cases = {"a &lt;b&gt; &amp;lt; &#65;&#x42;&#X1F600; &nbsp; x": "a <b> &lt; AB😀   x", "&nope; &amp &;&#0;&#xD800; &#99999999;": "&nope; &amp &;&#0;&#xD800; &#99999999;", "&auml;&Auml;&euro;&apos;&quot;": "äÄ€'\"", "": "", "&": "&", " a\n\t b ": "a b", "&amp;amp;": "&amp;"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    assert [r.v for r in df.select("i", text.html_decoded(F.col("h")).alias("v")).orderBy("i").collect()] == list(cases.values())


def test_every_query_gets_its_row(spark):
    listed = spark.createDataFrame([(1, "/a/x", "x"), (2, "/b/x", "x"), (3, "/c/y", "y")], "row_id int, path string, name string")
    hits = spark.createDataFrame([(1, "/A/X", "x"), (2, "/a/x", "x"), (3, "/q/y", "y"), (4, "/q/x", "x"), (5, "/q/z", "z"), (6, "/q/z", "z")], "hit int, path string, name string")
    assert {r.hit: r.row_id for r in dedup.matched(hits, listed).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: None, 6: None}
    assert {r.hit: r.row_id for r in dedup.lookup(hits, listed).collect()} == {1: 1, 3: 3, 4: 1, 5: None}


def test_shares_of_pixels_sum_to_the_correlation(spark):
    rng = np.random.default_rng(8)
    fields = spark.createDataFrame([(f, p, 1.0 if f == 5 else float(v)) for f in range(6) for p, v in enumerate(rng.normal(size=9))], "field long, p int, v double")
    shown = masks.pattern(masks.learn(fields.withColumn("half", F.col("field") % 2), "half"), "half").withColumnRenamed("half", "mask")
    sums = masks.contributions(fields, shown).groupBy("field", "mask").agg(F.sum("share").alias("s"), F.count(F.lit(1)).alias("n"))
    both = masks.match(fields, shown).join(sums, ["field", "mask"]).collect()
    assert len(both) == 10 and all(abs(r.value - r.s) < 1e-9 and r.n == 9 for r in both)  # a flat field has no shares


@pytest.mark.parametrize("rows", [0, 100_000])
def test_many_masks_meet_by_pixel_and_salt(spark, monkeypatch, rows):
    monkeypatch.setattr(masks, "sized", lambda df: df if not rows else F.broadcast(df))
    rng = np.random.default_rng(9)
    fields = spark.createDataFrame([(f, p, float(v)) for f in range(20) for p, v in enumerate(rng.normal(size=4))], "field long, p int, v double")
    shown = masks.pattern(masks.learn(fields.withColumn("mask", F.col("field") % 3), "mask"), "mask")
    assert masks.match(fields, shown).count() == 60


def test_equal_masks_are_assigned_by_number(spark):
    rng = np.random.default_rng(10)
    mark = np.sin(np.arange(12))
    fields = spark.createDataFrame([(0, f, 0, 0, p, float(v)) for f in range(8) for p, v in enumerate(mark + 0.3 * rng.normal(size=12))], "folder long, field long, mode int, area int, p int, v double")
    old = [(k, p, float(6 * mark[p]), float(6 * mark[p] ** 2 + 0.3)) for k in (4, 2, 7) for p in range(12)]
    sums = spark.createDataFrame(old, "mask long, p int, total double, squares double")
    catalogue = lambda sep, mode=0: spark.createDataFrame([(k, mode, 0, 6, 0.1, sep) for k in (4, 2, 7)], "mask long, mode int, area int, n long, threshold double, separability double")
    for sep, way in ((0.4, "share"), (0.1, "gain")):
        assert [(r.mask, r.way) for r in masks.assigned(fields, catalogue(sep), sums).collect()] == [(2, way)]
    for known in (catalogue(None), catalogue(-0.1), catalogue(0.4, 1)):  # never measured, of no use, of another mode
        assert masks.assigned(fields, known, sums).count() == 0
    assert masks.assigned(fields.filter("field < 4"), catalogue(0.4), sums).count() == 0


def test_windows_of_small_pictures(spark):
    values = F.array(*(F.lit(float(i)) for i in range(64)))
    df = spark.range(1)
    assert df.select(raster.heat_map(values, 8, 8, lambda c: c[0]).alias("v")).first()["v"] is None
    got = df.select(raster.heat_map(values, 8, 8, lambda c: c[0], grid=2).alias("v")).first()["v"]
    assert [(r["row"], r["col"], r["score"]) for r in got] == [(0, 0, 0.0), (0, 1, 4.0), (1, 0, 32.0), (1, 1, 36.0)]
    assert raster.crop_places(17, 100) is None and raster.crop_places(18, 100) == [(5, 46, 8), (0, 0, 8), (10, 0, 8), (0, 92, 8), (10, 92, 8)]
    same = df.select(raster.bilinear(values, 8, 8, 8, 8).alias("v"), raster.bilinear(values, 8, 8, 1, 1).alias("w")).first()
    assert same["v"] == [float(i) for i in range(64)] and same["w"] == [0.0]
