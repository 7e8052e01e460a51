"""Running medians of a stream equal those of the whole table, however it is cut and restarted."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import rating
from pixelloom.streaming import incremental, ratings

SCHEMA = "folder string, path string, v double, at long, fresh boolean"


def run(spark, src, tmp_path, cuts, rows, **kw):
    """Files come one after the other; the query stops and starts again after each of them."""
    at, out = 0, tmp_path / f"out-{len(cuts)}"
    src.mkdir()
    for n in [*cuts, len(rows)]:
        if rows[at:n]:
            spark.createDataFrame(rows[at:n], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        at = n
        stream = ratings.running_medians(incremental.file_stream(spark, str(src), SCHEMA), "folder", "path", "v", "at", **kw)
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(60)
    return {r["at"]: r.running_median for r in spark.read.parquet(str(out)).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(rng.choice(["a", "a", "b", None]), f"p{i}", rng.choice([None, 0.0, -1.0, float(rng.randrange(9)), rng.random()]), i, False) for i in range(60)]


@pytest.mark.parametrize("cuts", [[], [1, 20, 41]])
def test_stream_equals_table(spark, tmp_path, rows, cuts):
    got = run(spark, tmp_path / "in", tmp_path, cuts, rows)
    want = rating.running_medians(spark.createDataFrame(rows, SCHEMA).select("folder", "v", "at"), "folder", "v", "at").collect()
    assert got == {r["at"]: r.running_median for r in want}


def test_paths_measured_again_and_resets(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"p{rng.randrange(6)}", rng.choice([None, float(rng.randrange(1, 20))]), i, i in (17, 30)) for i in range(50)]
    seen, want = {}, {}
    for f, p, v, at, fresh in rows:
        if fresh:
            seen[f] = {}
        seen.setdefault(f, {})[p] = v
        values = sorted(x for x in seen[f].values() if x)
        want[at] = values[len(values) // 2] if values else None
    assert run(spark, tmp_path / "in", tmp_path, [9, 10, 33], rows, reset="fresh") == want


def test_untouched_folders_expire(spark, tmp_path):
    """Values that no batch has touched for longer than `expire` are forgotten; a stream with a clock never ends by itself."""
    out = tmp_path / "out"
    (tmp_path / "in").mkdir()
    result = lambda: spark.read.schema(f"{SCHEMA}, running_median double").parquet(str(out))
    stream = ratings.running_medians(incremental.file_stream(spark, str(tmp_path / "in"), SCHEMA), "folder", "path", "v", "at", expire="1 second")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").start(str(out))
    try:
        for at, rows in ((2, [("a", "p0", 9.0, 0, False), ("a", "p1", 8.0, 1, False)]), (3, [("a", "p2", 1.0, 2, False)])):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            end = time.time() + 60
            while time.time() < end and (not (out / "_spark_metadata").exists() or result().count() < at):
                time.sleep(0.5)
            time.sleep(3)
    finally:
        q.stop()
    assert {r["at"]: r.running_median for r in result().collect()} == {0: 9.0, 1: 9.0, 2: 1.0}


def test_sink_of_a_retried_batch_replaces_it(spark, tmp_path):
    write = incremental.index_sink(lambda d: d.withColumn("d", F.lit(1)), str(tmp_path / "out"))
    for _ in range(2):
        write(spark.range(3).toDF("x"), 0)
    write(spark.range(2).toDF("x"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("epoch").count().orderBy("epoch").collect() == [(0, 3), (1, 2)]
