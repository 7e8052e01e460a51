import json
import struct
import zlib

from pyspark.sql import functions as F

from pixelloom.sources import files
from pixelloom.streaming import incremental


def png(path, w, h, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_and_images(spark, tmp_path):
    (tmp_path / "s").mkdir()
    png(tmp_path / "s" / "a.PNG", 3, 2, (10, 20, 30))
    (tmp_path / "b.txt").write_text("x")
    assert {(r.name, r.size) for r in files.scan_files(spark, str(tmp_path)).filter("extension = 'txt'").collect()} == {("b.txt", 1)}
    assert files.scan_files(spark, str(tmp_path), extensions=files.LIST_EXTENSIONS).count() == 1
    px = files.read_images(spark, str(tmp_path / "s")).collect()
    assert {(r.x, r.y, r.r, r.g, r.b) for r in px} == {(x, y, 10, 20, 30) for x in range(3) for y in range(2)}


def test_index_version_and_root(spark, tmp_path):
    entry = {"Path": "/R/x.jpg", "FileSize": 5, "LastWriteTicks": 9, "Descriptor": [3.0, 4.0], "Hash": 1, "Tags": {"a": "b"}, "Concepts": ["c"]}
    (tmp_path / "one.json").write_text(json.dumps({"Version": 2, "Entries": [entry, entry | {"Path": "/other/y.jpg"}]}, indent=1))
    (tmp_path / "old.json").write_text(json.dumps({"Version": 1, "Entries": [entry]}))
    (tmp_path / "bad.json").write_text("{nope")
    assert files.read_index(spark, str(tmp_path)).count() == 2
    own = files.read_index(spark, str(tmp_path), root="/r")
    assert [r.path for r in own.collect()] == ["/R/x.jpg"]
    files.write_table(own, str(tmp_path / "t"))
    assert files.read_vectors(spark, str(tmp_path / "t")).first()["descriptor"] == [0.6, 0.8]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * id) as ts, 'p' as path from range(6)").write.parquet(str(src))
    stream = incremental.debounced(incremental.file_stream(spark, str(src), "ts timestamp, path string"), gap="2 seconds")
    q = stream.writeStream.outputMode("append").format("memory").queryName("bursts").start()
    q.processAllAvailable()
    q.stop()
    # 0 and 1 form a burst; 4, 9, 16 stand alone; 25 still waits for its pause and the watermark.
    got = sorted(r.changes for r in spark.sql("select * from bursts").collect())
    assert got[-1] == 2
    rows = incremental.file_stream(spark, str(src), "ts timestamp, path string")
    q = rows.writeStream.foreachBatch(incremental.index_sink(lambda d: d.withColumn("d", F.lit(1)), str(tmp_path / "out"))).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_stores_round_trip_and_listing(spark, tmp_path):
    at = str(tmp_path / "texts")
    assert files.load_store(spark, "texts", at).count() == 0
    for stage in (3, 4):
        old = files.load_store(spark, "texts", at)
        row = spark.createDataFrame([("/a/x.png", 5, 9, "t", "de", stage)], files.STORES["texts"])
        files.save_store(old.unionByName(row), "texts", at)
    assert sorted(r.slant_stage for r in files.load_store(spark, "texts", at).collect()) == [3, 4]
    for kind in files.STORES:
        assert files.load_store(spark, kind, str(tmp_path / "none")).columns
    for name in ("b/i.json", "a/c/i.json", "a/other.json"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("{}")
    found = files.indexed_folders(spark, str(tmp_path / "tree"), "i.json")
    assert sorted(r.folder.rsplit("tree/", 1)[1] for r in found.collect()) == ["a/c", "b"]
    df = spark.createDataFrame([("b",), ("A",), ("a",)], "path string")
    assert [r.path for r in files.sorted_listing(df).collect()] == ["A", "a", "b"]
