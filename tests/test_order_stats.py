import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import lists, masks, order_stats, rating


def test_positions_and_counts_equal_a_sort(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(9) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, folder string, v int").repartition(5)
    got = [r.id for r in sorted(order_stats.numbered(df, -F.col("v"), "id").collect(), key=lambda r: r.position)]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))]
    want = {}
    for f in ("a", "b"):
        c = sorted(Counter(v for _, g, v in rows if g == f and v is not None).items())
        for k, (v, n) in enumerate(c):
            want[f, v] = (n, sum(m for _, m in c[:k]), sum(m for _, m in c), c[k + 1][0] if k + 1 < len(c) else None)
    out = {(r.folder, r.v): (r.n, r.before, r.total, r.next) for r in order_stats.cumulated(df, "v", "folder").collect()}
    assert out == want
    assert order_stats.numbered(df.limit(0), "id").count() == 0
    assert [r.chunk for r in lists.chunked(df.select("id"), F.col("id")).orderBy("id").collect()] == [i // 5 for i in range(300)]


@pytest.mark.parametrize("n", [1, 2, 3, 12, 40])
def test_threshold_and_gap_equal_brute_force(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(12) / 16 for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    s = sorted(values)
    t = masks.threshold(df).first()
    assert (t.threshold, t.separability) == (min(0.9, max(0.1, s[int(n * 0.1)] * 0.75)), s[int(n * 0.5)])
    lo, hi = int(n * 0.1), min(int(n * 0.9) - 1, n - 2)
    gaps = [(s[i + 1] - s[i], -i) for i in range(lo, hi + 1)]
    got = masks.largest_gap(df).collect()
    assert [(r.gap, r.below) for r in got] == ([(max(gaps)[0], 1 - max(gaps)[1])] if gaps else [])


def test_running_medians_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0, -2, *range(1, 30)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, folder string, v int")
    want, seen = {}, {}
    for i, f, v in rows:
        s = sorted(seen.setdefault(f, []) + ([v] if v and v > 0 else []))
        seen[f] = s
        want[i] = s[len(s) // 2] if s else None
    assert {r.id: r.running_median for r in rating.running_medians(df, "folder", "v", "id").collect()} == want


def test_split_needs_two_marks(spark):
    rng = random.Random(1)
    wave = [[(-1) ** p for p in range(64)], [(-1) ** (p // 8) for p in range(64)]]
    rows = lambda kinds: [(i, p, 2.0 * wave[k][p] + rng.gauss(0, 0.5)) for i, k in enumerate(kinds) for p in range(64)]
    two = [0] * 14 + [1] * 8
    got = masks.split(spark.createDataFrame(rows(two), "field long, p int, v double")).collect()
    sides = {r.field: r.upper for r in got}
    assert len(got) == 22 and {sides[i] for i in range(14)} == {True} and {sides[i] for i in range(14, 22)} == {False}
    assert masks.split(spark.createDataFrame(rows([0] * 20), "field long, p int, v double")).count() == 0
    assert masks.split(spark.createDataFrame(rows([0] * 6 + [1] * 4), "field long, p int, v double")).count() == 0
