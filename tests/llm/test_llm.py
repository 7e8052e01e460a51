"""Training-data operators against brute force, oracle SQL and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import chat_format, decontamination, jaccard_join, license_scan, lm_scoring, mixing, quality_classifier, quality_rules, queries, sharding, suffix_dedup
from pixelloom.llm.shared import crc_of

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def corpus(seed=1, n=60):
    """Random prose with copies, near copies, shared passages, nulls, empty, blank, short and one very long text, and a repeated row."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)] + ["Öl", "É", "a1", "#x", "<|im_end|>"]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, texts = prose(40), []
    for i in range(n):
        t = prose(rng.randint(30, 120))
        if i % 7 == 1 and texts:
            t = texts[-1]
        elif i % 7 == 2:
            w = texts[-1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif i % 7 == 3:
            t = prose(20) + " " + passage + "\n" + prose(15)
        texts.append(t)
    texts += [None, "", " \t\n", "one", "One", "one two", "a b c d", "A b c d", prose(6000), "ab" * 200, "ab" * 150 + "x"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def test_classifier_learns_held_out(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "fine", "plain"]) + str(rng.randrange(50)) for _ in range(30)) if i % 2 else " ".join(rng.choice("ABC") * 3 + "!!" for _ in range(30)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    w = quality_classifier.train_classifier(df.filter("doc_id < 200"))
    out = quality_classifier.score(df.filter("doc_id >= 200"), w).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out]) > 0.98


def test_classifier_edges(spark, docs, empty, rows):
    none = quality_classifier.train_classifier(spark.createDataFrame([], "text string, label int"))
    assert not none.any()
    out = quality_classifier.score(docs, none).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    assert quality_classifier.score(empty, none).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
def test_classifier_query_ranks_labels(spark):
    d = "/root/testdata/sf0.01"
    out = quality_classifier.op1_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_classifier_against_plain_updates(spark):
    """FTRL row by row over dictionaries, in the same parts and order; null and empty texts score by the bias."""
    rng = random.Random(12)
    good, bad = [f"word{i}" for i in range(40)], [f"BUY{i}!" for i in range(40)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randint(5, 30))), i % 2) for i in range(40)] + [(40, None, 1), (41, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    dealt = df.select("*", F.xxhash64("doc_id").alias("order")).select("*", F.pmod(F.xxhash64("order"), F.lit(quality_classifier.PARTS)).alias("part")).orderBy("order").collect()
    alpha, beta, l1 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1

    def features(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, slot, value = quality_classifier.features(raw, np.array([0, len(raw)]))
        return dict(zip(slot.tolist(), value.tolist(), strict=True)) | {1 << quality_classifier.BITS: 1.0}

    models = []
    for part in sorted({r.part for r in dealt}):
        z, n = {}, {}

        def weight(k, z=z, n=n):
            v = z.get(k, 0.0)
            return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha)

        for _ in range(quality_classifier.EPOCHS):
            for r in dealt:
                if r.part != part:
                    continue
                x = features(r.text)
                w = {k: weight(k) for k in x}
                p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
                for k, v in x.items():
                    g = (p - r.label) * v
                    z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha * w[k]
                    n[k] = n.get(k, 0.0) + g * g
        models.append({k: weight(k) for k in z})
    got = quality_classifier.train_classifier(df, order=F.xxhash64("doc_id"))
    want = {k: sum(m.get(k, 0.0) for m in models) / len(models) for k in set().union(*models)}
    assert {k: float(got[k]) for k in want} == pytest.approx(want, abs=1e-4)
    assert np.count_nonzero(got) == sum(1 for v in want.values() if v)
    scores = {r.doc_id: r.score for r in quality_classifier.score(df, got).collect()}
    for i, text, _ in rows:
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-sum(want.get(k, 0.0) * v for k, v in features(text).items()))), abs=1e-4)


# 2


def repeats(texts, length):
    """Brute force over (key, bytes) in order."""
    first, out = {}, {}
    for k, b in texts:
        cov = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if first.setdefault(x, (k, s)) != (k, s):
                cov[s : s + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, cov, strict=True) if not m)
        spans = sum(1 for j in range(len(cov)) if cov[j] and (j == 0 or not cov[j - 1]))
        out[k] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark, docs, rows):
    want = repeats([(i, (t or "").encode()) for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0])], 100)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_dedup_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    df = spark.createDataFrame([(None, "z" * 150), (1, "z" * 150)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()) == [(False, 150, 1), (True, 149, 1)]


def test_suffix_array_orders_suffixes():
    rng = random.Random(8)
    data = bytes(rng.choice(b"ab\0") for _ in range(400))
    at = np.arange(400 - 12 + 1)
    order, head = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), at, at * 0, 12)
    want = sorted(at.tolist(), key=lambda i: (data[i : i + 12], i))
    assert order.tolist() == want
    assert head.tolist() == [k == 0 or data[i : i + 12] != data[want[k - 1] : want[k - 1] + 12] for k, i in enumerate(want)]


def test_suffix_dedup_merges_arrays_of_a_trigger(spark, monkeypatch):
    """One passage in many contexts: its phrases are dealt to several arrays, and nothing changes."""
    rng = random.Random(6)
    new = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    passage, left, right = new(140), [new(60) for _ in range(9)], [new(60) for _ in range(7)]
    rows = [(i, new(50) + rng.choice(left)[-rng.randint(1, 60) :] + passage + rng.choice(right)[: rng.randint(1, 60)] + new(50)) for i in range(60)]
    want = repeats([(i, t.encode()) for i, t in rows], 100)
    monkeypatch.setattr(suffix_dedup, "ENTRIES", 4)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_dedup_judges_rows_not_keys(spark):
    """Rows that share a key, or have none, lose only what really repeats."""
    rng = random.Random(4)
    new = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, rows = new(400), []
    rows = [(1, a), (7, a), (7, new(400)), (None, "z" * 150), (None, new(400)), (7, "-" * 50 + a[100:300]), (1, a)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 150, 50 - 1 + 100), (0, 400, 0), (1, 400, 0), (1, 400, 0), (7, 250, 200), (7, 400, 0), (7, 400, 400)]


# 3


def contaminated(rows, items):
    wins = {}
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    for k, t in items:
        w = tok(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = {}
    for k, t in rows:
        w, hit, found = tok(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[x]
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("bound", [20_000, 0])
def test_decontamination_against_brute_force(spark, docs, rows, bound):
    items = [(1, rows[3][1][50:300]), (2, None), (3, ""), (4, "one two"), (5, rows[10][1]), (10, rows[10][1]), (6, "É"), (7, "A, b; C d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench, broadcast_prefixes=bound).collect()
    want = contaminated([(r[0], r[1]) for r in rows], items)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert any(v[4] for v in want.values())


def test_decontamination_empty(spark, docs, empty, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.decontaminate(docs, none).collect()} == {0}
    assert decontamination.decontaminate(empty, none).count() == 0


# 4


def test_water_filling_and_flow():
    t = mixing.water_filled([10, 10, 100], [5, 2, 1])
    assert t == pytest.approx([30, 30, 60]) and sum(t) == pytest.approx(120)
    # Two patterns share a source: the document of both is used once for each before anything repeats.
    assert mixing.min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [15, 15]) == [10, 10, 10]
    assert mixing.min_cost_flow([10, 5], [[0], [1]], [25, 5]) == [25, 5]


def test_mixing_meets_targets(spark, docs, rows, empty):
    out = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text"))).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5), F.array("source"), mixing.word_count(F.col("text"))).collect())
    by = {}
    for r in out:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken == r.copies * r.size <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda x: (x is None, x or ""))
    sizes = [sum(r.size for r in by[n]) for n in names]
    want = mixing.water_filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, s, t in zip(names, sizes, want, strict=True):
        assert {(r.source_size, round(r.target, 6)) for r in by[n]} == {(s, round(t, 6))}
        assert abs(sum(r.taken for r in by[n]) - t) <= max(0.02 * t, *(r.size for r in by[n]))
    assert mixing.mix(empty, F.array("source"), mixing.word_count(F.col("text"))).count() == 0


def test_flow_is_cheapest():
    """Brute force over all whole-number flows of three patterns and two sources."""
    rng = random.Random(6)
    for _ in range(40):
        sizes, members = [rng.randint(0, 3) for _ in range(3)], [[0], [0, 1], [1]]
        quotas = [rng.randint(0, 7), rng.randint(0, 7)]
        cost = lambda p, f: sum(k // sizes[p] for k in range(f)) if sizes[p] else 0
        best = min(((-a - b - c - d, cost(0, a) + cost(1, b + c) + cost(2, d)) for a in range(3 * sizes[0] + 1) for b in range(3 * sizes[1] + 1) for c in range(3 * sizes[1] + 1 - b) for d in range(3 * sizes[2] + 1) if a + b <= quotas[0] and c + d <= quotas[1]))
        got = mixing.flows(sizes, members, quotas)
        assert (-sum(got), sum(cost(p, f) for p, f in enumerate(got))) == best
    assert mixing.flows([4, 5], [[0], [1]], [9, 20]) == [9, 15]


def flow_cost(sizes, flow):
    """(what is taken, cost of repeating)."""
    return sum(flow), sum(k // n for n, f in zip(sizes, flow, strict=True) for k in range(f))


def plain_flow(sizes, members, quotas, epochs=3):
    """Units of flow one by one along the cheapest way, by trying all ways: (taken from each pattern)."""
    taken, given = [0] * len(sizes), [Counter() for _ in sizes]
    left = list(quotas)
    while True:
        best = None
        for p, n in enumerate(sizes):
            if taken[p] < epochs * n:
                # Sources that p can reach by moving what others have from one source to another.
                seen, queue = {}, [(s, (p, s, None)) for s in members[p]]
                while queue:
                    s, how = queue.pop(0)
                    if s in seen:
                        continue
                    seen[s] = how
                    for q, m in enumerate(members):
                        if given[q][s] > 0:
                            queue += [(x, (q, x, s)) for x in m]
                ends = [s for s in seen if left[s] > 0]
                if ends and (best is None or taken[p] // n < best[0]):
                    best = (taken[p] // n, p, ends[0], seen)
        if best is None:
            return taken
        _, p, s, seen = best
        left[s] -= 1
        while s is not None:
            q, x, before = seen[s]
            given[q][x] += 1
            if before is not None:
                given[q][before] -= 1
            s = before
        taken[p] += 1


def test_flow_against_single_units():
    rng = random.Random(15)
    for _ in range(60):
        n_s, n_p = rng.randint(1, 4), rng.randint(1, 7)
        members = [sorted(rng.sample(range(n_s), rng.randint(1, n_s))) for _ in range(n_p)]
        sizes, quotas = [rng.randint(0, 6) for _ in range(n_p)], [rng.randint(0, 25) for _ in range(n_s)]
        got, want = mixing.min_cost_flow(sizes, members, quotas), plain_flow(sizes, members, quotas)
        assert flow_cost(sizes, got) == flow_cost(sizes, want) and all(x <= 3 * n for n, x in zip(sizes, got, strict=True))


def test_flow_over_many_overlapping_patterns():
    rng = random.Random(16)
    members = [sorted(rng.sample(range(40), rng.randint(1, 5))) for _ in range(20_000)]
    sizes = [rng.randint(1, 10**6) for _ in members]
    of = [sum(n for n, m in zip(sizes, members, strict=True) if s in m) for s in range(40)]
    quotas = [round(t) for t in mixing.water_filled(of, [(5, 2, 1)[i % 3] for i in range(40)])]
    flow = mixing.min_cost_flow(sizes, members, quotas)
    assert 0.99 * sum(quotas) <= sum(flow) <= sum(quotas) and all(f <= 3 * n for f, n in zip(flow, sizes, strict=True))


def filled(rows, gap, goal):
    """Brute force of the gap of a pattern: (place, size) of the documents that fill it."""
    chosen, left = set(), sorted(r for r in rows if r[1] > 0)
    while gap > goal:
        got = 0
        for p, n in [r for r in left if r not in chosen and r[1] <= gap]:
            if got + n > gap:
                break
            got += n
            chosen.add((p, n))
        if not got:
            break
        gap -= got
    if gap > goal:
        over = [(n, p) for p, n in left if (p, n) not in chosen and n < 2 * gap]
        chosen |= {(p, n) for n, p in [min(over)]} if over else set()
    return chosen


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_mix_of_overlapping_sources_against_brute_force(spark, monkeypatch, broadcast):
    """Documents of several sources, shared and null ids, one very long text."""
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", broadcast)
    rng = random.Random(11)
    rows = [(None if i % 9 == 0 else i // 2, rng.choice([0, 3, 10, 40, 90]) + i % 5, rng.choice([["a"], ["a", "b"], ["b"], ["c"], ["c", None], [None], ["d"]])) for i in range(400)] + [(1000, 3000, ["c"])]
    df = spark.createDataFrame(rows, "doc_id long, words long, sources array<string>").repartition(4)
    out = mixing.mix(df, F.col("sources"), F.col("words"))
    got = out.withColumn("place", mixing.place(df)).collect()
    assert len(got) == len(rows)
    order = lambda p: sorted(set(p), key=lambda x: (x is None, x or ""))
    groups = {}
    for r in got:
        groups.setdefault(tuple(order(r.sources)), []).append(r)
    keys = sorted(groups, key=lambda k: [(x is None, x or "") for x in k])
    names = order({x for k in keys for x in k})
    sizes = [sum(r.words for r in groups[k]) for k in keys]
    of = [sum(n for n, k in zip(sizes, keys, strict=True) if x in k) for x in names]
    targets, open_, rest = {}, list(range(len(names))), sum(of)
    while open_:  # weights share what is left; who has more than three times its size stops there
        share = {i: rest * (5, 2, 1)[i % 3] / sum((5, 2, 1)[j % 3] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * of[i]]
        targets |= {i: 3 * of[i] for i in over} if over else share
        rest -= sum(3 * of[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    flow = mixing.min_cost_flow(sizes, [[names.index(x) for x in k] for k in keys], [round(targets[i]) for i in range(len(names))])
    best = plain_flow(sizes, [[names.index(x) for x in k] for k in keys], [round(targets[i]) for i in range(len(names))])
    assert flow_cost(sizes, flow) == flow_cost(sizes, best)
    for k, n, f in zip(keys, sizes, flow, strict=True):
        t = targets[names.index(k[0])]
        once = filled([(r.place, r.words) for r in groups[k]], f % n, mixing.NEAR * t)
        for r in groups[k]:
            assert r.copies == (f // n + ((r.place, r.words) in once) if r.words else 0)
            assert (r.source_size, round(r.target, 6)) == (of[names.index(k[0])], round(t, 6))
        assert abs(sum(r.taken for r in groups[k]) - f) <= max(mixing.NEAR * t, 4)


# 5


def classes(rows, n, percent):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {k: (len(s), root(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(docs, rows, n, percent):
    got = jaccard_join.jaccard_classes(docs, n, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes([(r[0], r[1]) for r in rows], n, percent)


def test_jaccard_chains_and_hot_groups(spark):
    """A chain whose ends don't link, a large group of near copies, and a passage in most texts."""
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(12):
        w = w[6:] + [f"v{i}-{j}" for j in range(6)]
        rows.append((len(rows), " ".join(w)))
    base = [f"b{j}" for j in range(150)]
    for i in range(80):
        x = list(base)
        x[rng.randrange(150)] = f"c{i}"
        rows.append((len(rows), " ".join(x)))
    line = " ".join(f"l{j}" for j in range(12))
    for i in range(80):
        rows.append((len(rows), line + " " + " ".join(f"u{i}-{j}" for j in range(rng.randint(2, 30)))))
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows, 4, 85)


def test_jaccard_judges_rows_not_keys(spark):
    """Null, repeated and textual keys: every row counts by its own text."""
    w = [f"w{i}" for i in range(100)]
    near = " ".join(w[:97] + ["x", "y", "z"])
    rows = [(None, " ".join(w)), ("b", near), ("c", "quite other words than those of the rest"), ("b", "still other words that nobody else has got"), (None, "alone and without any key at all")]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "k string, t string"), 4, 85, "k", "t").collect()
    assert sorted((r.k or "", r.n_shingles, r.component_id or "") for r in got) == [("", 4, ""), ("", 97, "b"), ("b", 5, "b"), ("b", 97, "b"), ("c", 5, "c")]


def test_jaccard_large_tiles_are_dealt_to_blocks(spark, monkeypatch):
    """Many texts that share their rarest tokens and hardly link: blocks of a tile find what one block finds."""
    rng = random.Random(12)
    base = [f"b{j}" for j in range(60)]
    rows = []
    for i in range(90):
        x = list(base)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(60)] = f"c{rng.randrange(40)}"
        rows.append((i, " ".join(x)))
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 8)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows, 4, 85)


def test_jaccard_outsiders_alone_are_copied(spark):
    """N near copies and five outsiders in each tile: rows of blocks grow as N, and every pair but those inside the copies meets once."""
    for n in (300, 900, 2700):
        named = spark.range(n + 5).select(F.lit(1).alias("tile"), "id", F.lit(9).alias("n"), F.lit(0).alias("pos"), F.when(F.col("id") < n, F.lit(0)).otherwise(F.col("id")).alias("part"))
        dealt = jaccard_join._blocks(named.union(named.withColumn("tile", F.lit(2)).withColumn("part", F.lit(7))), 32)
        assert dealt.filter("tile = 2").count() == 0 and n < dealt.count() <= 1.2 * n + 20
        blocks = {}
        for r in dealt.collect():
            blocks.setdefault((r.i, r.j), []).append((r.side, r.id))
        met = Counter()
        for (i, j), rows in blocks.items():
            for (a, x), (b, y) in itertools.combinations(sorted(rows), 2):
                if i == j or a != b:
                    met[min(x, y), max(x, y)] += 1
        assert met == Counter((x, y) for y in range(n, n + 5) for x in range(y))


def test_jaccard_many_outsiders_in_large_tiles(spark, monkeypatch):
    """Two groups of near copies that one text joins, and many texts apart, in blocks of a few rows."""
    rng = random.Random(21)
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 4)
    base, rows = [f"b{j}" for j in range(100)], []
    for i in range(60):
        x = list(base) if i % 3 else [*base[:90], *(f"d{j}" for j in range(10))]
        x[rng.randrange(100)] = f"c{i}"
        rows.append((i, " ".join(x)))
    rows.append((60, " ".join([*base[:95], *(f"d{j}" for j in range(5))])))
    rows += [(61 + i, " ".join([*base[: rng.randint(20, 95)], *(f"e{i}-{j}" for j in range(rng.randint(3, 60)))])) for i in range(40)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows, 4, 85)


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_classes(empty).count() == 0


# 6


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nhi", "a\\|b\\\\n\\", "", None, "<|", "\\n", "É" * 10]
    rows = [(c, t, "assistant" if (t + c) % 2 else ("us\ner\\n" if c == 2 else "user"), odd[(c + t) % len(odd)]) for c in range(4) for t in range(c + 2)] + [(9, 0, "user", "alone"), (None, 1, None, "x"), (9, None, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.expand_prefixes(df)).collect()}
    convs = {}
    for c, t, role, x in rows:
        convs.setdefault(c, []).append((t is None, t or 0, role or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat_format.expand_prefixes(df).collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == r.example
    assert chat_format.read_back(chat_format.expand_prefixes(df.limit(0))).count() == 0


# 7


def test_quality_rules_brute_force(docs, rows, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = Counter(zip(w, w[1:], w[2:]))
        twice = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if three[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and (r.kept == (r.rejected_by is None)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    words_ = F.concat(F.lit("a b c "), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 60))
    df = quality_rules.with_base_counts(spark.range(200).select(F.concat(words_, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: i.cast("string")), " ")).alias("text")), keep=True)
    rules = [quality_rules.Rule("never", F.lit(False)), quality_rules.Rule("dear", F.size("_words") > 0, F.size("_words")), quality_rules.Rule("cheap", F.col("n_words") > 0)]
    assert [r.name for r in quality_rules.ordered_rules(df, rules)] == ["cheap", "dear", "never"]


def test_rules_after_a_rejection_are_not_evaluated(spark):
    """A later rule that would raise an error is never reached."""
    df = spark.range(50).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: (i * 7919 + F.col("id")).cast("string")), " ").alias("text"))
    rules = [quality_rules.Rule("all", F.col("n_words") > 0), quality_rules.Rule("zz_raises", F.raise_error(F.lit("reached")).cast("boolean"))]
    out = quality_rules.with_base_counts(df, keep=True).select(quality_rules.cascade(rules).alias("by")).collect()
    assert {r.by for r in out} == {"all"}


def test_long_clean_text_is_kept(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(1, " ".join(rng.choice(vocab) for _ in range(200_000))), (2, "spam spam eggs " * 60 + " ".join(rng.choice(vocab) for _ in range(170)))], "doc_id long, text string")
    got = {r.doc_id: r.rejected_by for r in quality_rules.quality_rules(df).collect()}
    assert got[1] is None and got[2] is not None


# 8


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_hilbert_neighbours_touch(spark, n, bits):
    df = spark.range(1 << (n * bits)).select(*((F.shiftright("id", i * bits) % (1 << bits)).alias(f"d{i}") for i in range(n)))
    out = df.withColumn("h", sharding.hilbert_index([F.col(f"d{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in out] == list(range(1 << (n * bits)))
    assert all(sum(abs(a[f"d{i}"] - b[f"d{i}"]) for i in range(n)) == 1 for a, b in zip(out, out[1:]))


def test_shards_are_even_and_gapless(docs, rows, empty):
    for n in (7, 200):
        out = sharding.shard_by_curve(docs, n).collect()
        assert len(out) == len(rows)
        count = Counter(r["shard"] for r in out)
        per = [count[s] for s in range(n)]
        assert max(per) - min(per) <= 1
        assert all(sorted(r.slot for r in out if r["shard"] == s) == list(range(count[s])) for s in count)
        text = {r[0]: (r[1] or "").encode() for r in rows}
        assert all((r["size"], r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in out)
        order = sorted(out, key=lambda r: (r["shard"], r.slot))
        assert [r.curve for r in order] == sorted(r.curve for r in out)
    assert sharding.shard_by_curve(empty, 5).count() == 0


def hilbert(cells, bits):
    """Brute force: the index of a cell along the curve, by the published loops."""
    x, n = list(cells), len(cells)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= (q - 1) if x[-1] & q else 0
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_against_brute_force(spark):
    """Sources with a long common prefix are told apart, and every row stands where a sort of all rows puts it."""
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 40), rng.choice(["de", "en", None]), None if i % 29 == 0 else "https://site-" + "ab"[rng.random() < 0.3] + str(rng.randrange(4))) for i in range(300)]
    out = sharding.shard_by_curve(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5), 7, bits=4).collect()

    def cells(values):
        count = Counter(v for v in values if v is not None)
        share = -(-sum(count.values()) // 16)
        weight = {v: min(c, share) for v, c in count.items()}
        total, at, low = sum(weight.values()), 0, {}
        for v in sorted(weight):
            low.setdefault(at * 16 // total, v)
            at += weight[v]
        cuts = sorted(low.values())[1:]
        return lambda v: 0 if v is None else sum(c <= v for c in cuts)

    sizes = sorted(len(r[1]) for r in rows)
    cuts = sorted({sizes[math.ceil(len(sizes) * i / 16) - 1] for i in range(1, 16)})
    source, lang = cells([r[3] for r in rows]), cells([r[2] for r in rows])
    curve = {r[0]: hilbert((source(r[3]), lang(r[2]), sum(c <= len(r[1]) for c in cuts)), 4) for r in rows}
    assert {r.doc_id: r.curve for r in out} == curve and len({source(f"https://site-{a}{b}") for a in "ab" for b in range(4)}) == 8
    order = sorted(rows, key=lambda r: (curve[r[0]], zlib.crc32(r[1].encode()), r[0]))
    want = {r[0]: (i * 7 // 300, i - -(-(i * 7 // 300) * 300 // 7)) for i, r in enumerate(order)}
    assert {r.doc_id: (r["shard"], r.slot) for r in out} == want


# 9


def test_lm_scores_against_brute_force(docs, rows, empty):
    got = lm_scoring.lm_scores(docs, crc_of(F.col("doc_id")) % 3 == 0).collect()
    assert len(got) == len(rows)
    tok = [(r[0], words(r[1]) + [None], zlib.crc32(str(r[0]).encode()) % 3 == 0) for r in rows]
    one, two = Counter(), Counter()
    for _, w, held in tok:
        if not held:
            one.update(w)
            two.update(zip([0, *w], w))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    mass = lambda u: lm_scoring.SHARE * one[u] if u != 0 and one[u] else lm_scoring.CONSTANT
    want = {}
    for k, w, held in tok:
        score = sum(math.log10((two[u, x] + mass(u) * p(x)) / ((one[None] if u == 0 else one[u]) + mass(u))) for u, x in zip([0, *w], w))
        want[k] = (held, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), score)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6) and abs(r.score - w[5]) <= 0.02 * w[1]
    assert lm_scoring.lm_scores(empty, F.lit(False)).count() == 0
    assert {r.train_tokens for r in lm_scoring.lm_scores(docs, F.lit(True)).collect()} == {0}


@pytest.mark.parametrize("frequent", [0, 40])
def test_lm_mass_is_the_count_of_every_context(docs, rows, monkeypatch, frequent):
    """The model does not change when its words are more than those whose counts are at hand everywhere."""
    held = crc_of(F.col("doc_id")) % 3 == 0
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, held).collect()}
    tok = [(r[0], words(r[1]) + [None], zlib.crc32(str(r[0]).encode()) % 3 == 0) for r in rows]
    one, two = Counter(), Counter()
    for _, w, out in tok:
        if not out:
            one.update(w)
            two.update(zip([0, *w], w))
    n, v = sum(one.values()), len(one)
    assert v > 2 * frequent
    mass = lambda u: one[u] if u != 0 and one[u] else 8
    for k, w, _ in tok:
        want = sum(math.log10((two[u, x] + mass(u) * (one[x] + 0.1) / (n + 0.1 * (v + 1))) / ((one[None] if u == 0 else one[u]) + mass(u))) for u, x in zip([0, *w], w))
        assert abs(got[k].score - want) <= 0.02 * len(w)


def test_elias_fano_finds_all(tmp_path):
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 1 << 44, 5000, dtype=np.uint64))
    cut = lambda x: (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF))
    ef = lm_scoring.EliasFano(*cut(v), 4, str(tmp_path / "level"))
    assert isinstance(ef.low.base, np.memmap) or isinstance(ef.low, np.memmap)
    assert (ef.find(*cut(v)) == np.arange(len(v))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 45, 5000, dtype=np.uint64), v)
    assert (ef.find(*cut(other)) == -1).all()
    assert (lm_scoring.EliasFano(*cut(v[:0]), 4, str(tmp_path / "none")).find(*cut(other)) == -1).all()


def test_texts_of_a_shard():
    for doc in ([3, 3, 1, 7], [60_000, 5], [], [0]):
        doc = np.array(doc, np.uint16)
        texts, at = lm_scoring._present(doc)
        assert texts.tolist() == sorted(set(doc.tolist())) and texts[at].tolist() == doc.tolist() and texts.dtype == doc.dtype


def test_lm_without_training_rows_is_dealt_to_many_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 500)
    got = lm_scoring.lm_scores(docs, F.lit(True)).collect()
    assert len(got) == len(rows) and all(r.n_known == 0 and math.isfinite(r.score) for r in got)


# 10


MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS."""
APACHE_TERMS = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License."""
BSD2 = """Copyright (c) 2020, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""
GPL = """    This program is free software{} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{} either version {} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
GPL_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version {}

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The licenses for most software {}
to take away your freedom to share and change {}."""


AFFERO = GPL.format(":", ",", 3).replace("GNU General Public License as published", "GNU Affero General Public License as published")
LESSER = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details."""
ADVERTISING = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the organization.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES."""
NOTICE = """, provided that the above
copyright notice and this permission notice appear in all copies"""
VERBATIM = """
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
FREEDOM = """

                            Preamble

  The licenses for most software {}
to take away your freedom to share and change {}."""


def test_licenses_that_look_alike(spark):
    texts = {
        "AGPL-3.0": AFFERO, "LGPL-2.1": LESSER, "BSD-4-Clause": BSD2 + ADVERTISING + BSD3.replace("3.", "4.") + BSD_END, "BSL-1.0": BOOST, "Zlib": ZLIB, "ISC": ISC.format(NOTICE), "0BSD": ISC.format(""),
        "LGPL-3.0": GPL.format(":", ",", 3).replace("GNU General Public License as", "GNU Lesser General Public License as"),
        "AGPL-3.0 ": VERBATIM + "\n  The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works." + FREEDOM.format("and other practical works are designed", "the works"),
        "GPL-3.0 ": VERBATIM + "\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works." + FREEDOM.format("and other practical works are designed", "the works"),
        "LGPL-2.1 ": VERBATIM + "\n[This is the first released version of the Lesser GPL.  It also counts\n as the successor of the GNU Library Public License, version 2, hence\n the version number 2.1.]" + FREEDOM.format("are designed", "it"),
        "LGPL-3.0 ": VERBATIM + "\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.",
    }
    forms = {"wrapped": lambda t: t, "unwrapped": lambda t: unwrapped(t.replace("\n * ", "\n").replace("\n *\n", "\n\n")), "within": lambda t: "Some text before it.\n\n" + t + "\n\nAnd text after it."}
    rows = [(name, form, f(t)) for name, t in texts.items() for form, f in forms.items()]
    df = spark.createDataFrame([(f"{n}|{f}", t) for n, f, t in rows], "doc_id string, text string")
    got = {r.doc_id: r.license_list for r in license_scan.license_scan(df).collect()}
    assert got == {f"{n}|{f}": n.strip() for n, f, _ in rows}


def test_license_expressions_and_denials(spark):
    texts = {
        "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;": "GPL-2.0", "<!-- SPDX-License-Identifier: mit -->": "MIT",
        "# SPDX-License-Identifier: (LGPL-2.1-or-later WITH Some-exception-1.0 OR MPL-2.0) AND ISC\nx": "ISC,LGPL-2.1,MPL-2.0", "SPDX-License-Identifier: GPL-3.0+": "GPL-3.0", "SPDX-License-Identifier: Nobody-1.0": "", "SPDX-License-Identifier:": "",
        "One.\nSPDX-License-Identifier: BSD-3-Clause\nReleased under the MIT License.": "BSD-3-Clause,MIT", "MIT OR Apache-2.0": "",
        "This project is not released under the MIT license.": "", "It isn't released under the MIT License": "", "No part was ever or is now released under the MIT license.": "MIT", "It is no longer being released under the MIT license.": "",
        "This is neither yours nor released under the MIT license.": "", "Not all of it, but this file, is released under the MIT License.": "MIT", "Code that cannot be licensed under the Apache License, Version 2.0": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.license_scan(df).collect()
    assert {list(texts)[r.doc_id]: r.license_list for r in got} == texts
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: (r[1], r[2]) for r in con.sql(f"SELECT doc_id, sentence_ids, license_list FROM ({license_scan.OP10_SQL})").fetchall()} == {r.doc_id: (",".join(r.sequence), r.license_list) for r in got}


def test_anchors_hit_every_sentence():
    known = [" ".join(p).split() for _, p, _ in license_scan.parsed(license_scan.SENTENCES)]
    found = license_scan.anchors(known)
    assert len(found) < 16 and all(len(w) > 5 for w in found) and all(any(w in x for w in found for x in s) for s in known)


def unwrapped(text):
    return re.sub(r"(?<!\n)\n(?!\n)[ ]*", " ", text)


def test_licenses_in_full_text(spark):
    texts = {
        "MIT": MIT, "Apache-2.0": APACHE, "Apache-2.0 ": APACHE_TERMS, "BSD-2-Clause": BSD2 + BSD_END, "BSD-3-Clause": BSD2 + BSD3 + BSD_END, "GPL-2.0": GPL.format(";", ";", 2), "GPL-3.0": GPL.format(":", ",", 3),
        "GPL-2.0 ": GPL_TEXT.format("2, June 1991", "are designed", "it"), "GPL-3.0 ": GPL_TEXT.format("3, 29 June 2007", "and other practical works are designed", "the works"),
    }
    forms = {"wrapped": lambda t: t, "unwrapped": unwrapped, "comment": lambda t: "\n".join(" * " + x for x in t.split("\n")), "within": lambda t: "Some text before it.\n\n" + t + "\n\nAnd text after it."}
    rows = [(name, form, f(t)) for name, t in texts.items() for form, f in forms.items()]
    df = spark.createDataFrame([(f"{n}|{f}", t) for n, f, t in rows], "doc_id string, text string")
    got = {r.doc_id: r.license_list for r in license_scan.license_scan(df).collect()}
    assert got == {f"{n}|{f}": n.strip() for n, f, _ in rows}


def test_license_rules_need_their_order(spark, docs, rows, empty):
    mit = [" ".join(x.split()) for x in MIT.split("\n\n")[2:]]
    texts = {
        1: "Intro text.\nReleased under the MIT License.\nMore", 2: "\n\n".join(mit), 3: "\n\n".join(reversed(mit)), 4: "Licensed under the APACHE License, Version 2.0", 5: None, 6: "", 7: "the mit license",
        8: "No stop before\nReleased under the MIT License\nnor after it", 9: "This file is released under the MIT License and may be copied.", 10: "released under the mit licenses",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.license_list for r in license_scan.license_scan(df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "", 4: "Apache-2.0", 5: "", 6: "", 7: "", 8: "MIT", 9: "MIT", 10: ""}
    assert license_scan.license_scan(docs).count() == len(rows) and license_scan.license_scan(empty).count() == 0


def test_license_sentences_of_the_caller(spark):
    df = spark.createDataFrame([(1, "Free for academic\nuse only!"), (2, "FREE for academic use only, and more"), (3, "x"), (4, "Grün ist das Gras. Ende")], "doc_id long, text string")
    own = {"acad": "free for academic use only", "green": "GRÜN ist ..."}
    got = {r.doc_id: r.license_list for r in license_scan.license_scan(df, sentences=own, rules=[("Academic", ["acad"]), ("Green", ["green"])]).collect()}
    assert got == {1: "Academic", 2: "", 3: "", 4: "Green"}
    assert {r.license_list for r in license_scan.license_scan(df, sentences={}, rules=[]).collect()} == {""}


# Queries and pipeline


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(queries.SQL[name])
    at = [list(want.columns).index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rows = corpus(3, 40)
    items = [(1, rows[3][1][60:260]), (2, "nothing like this is anywhere in here at all my friend")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        steps.append((name, at.collect()))
        assert name == "sharding" or at.columns == cp.COLUMNS
    kept = {r.doc_id for r in steps[0][1]}
    judged = {r.doc_id for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()}
    assert kept == judged
    text = {r[0]: r[1] for r in rows}
    part = classes([(k, text[k]) for k in sorted(kept)], 5, 80)
    assert sorted(r.doc_id for r in steps[1][1]) == sorted(k for k in kept if part[k][1] == k)
    bad = contaminated([(r.doc_id, r.text) for r in steps[1][1]], items)
    clean = {k for k, v in bad.items() if not v[4]}
    assert {r.doc_id for r in steps[2][1]} == clean and len(clean) < len(bad)
    assert set(Counter(r.doc_id for r in steps[3][1]).values()) <= {1, 2, 3}
    assert sorted(r.doc_id for r in steps[4][1]) == sorted(r.doc_id for r in steps[3][1])
    assert cp.run(spark, str(tmp_path)).count() == len(steps[4][1])


def test_pipeline_stages_judge_rows_not_ids(spark, tmp_path):
    """Rows without doc_id and rows that share one are kept or dropped each by its own text."""
    import corpus_pipeline as cp

    rng = random.Random(5)
    a, b, c, d, e, bad = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6))
    row = lambda k, t: (k, t, "en", "s", len(t or ""))
    rows = [row(None, a), row(None, b), row(None, b), row(7, c), row(7, d), row(8, e), row(None, e), row(9, e), row(9, a), row(5, " "), row(5, " "), row(None, " ")]
    for more in ([], [row(11, bad), row(11, bad)]):
        near = cp.keep_one_of_near(spark, spark.createDataFrame(rows + more, SCHEMA).repartition(3), "").collect()
        want = [row(9, a), row(None, b), row(7, c), row(7, d), row(8, e), row(5, " "), row(None, " "), *more[:1]]
        assert sorted(map(str, map(tuple, near))) == sorted(map(str, want))
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dirty = [row(None, bad), row(7, bad + " x")]
    clean = cp.drop_contaminated(spark, spark.createDataFrame([*rows, row(None, None), *dirty], SCHEMA), str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, clean))) == sorted(map(str, [*rows, row(None, None)]))


def test_extra_columns_with_clashing_names(spark, rows):
    more = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, curve long, shard int, score double, kept boolean, copies long, id long, word string"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, True, 6, 7, "w") for r in rows[:20]], more)
    assert quality_rules.quality_rules(df).count() == 20
    assert jaccard_join.jaccard_classes(df).count() == 20
    assert suffix_dedup.remove_repeats(df).count() == 20
    assert mixing.mix(df, F.array("source"), mixing.word_count(F.col("text"))).filter("copies > 0").count() > 0
    assert sharding.shard_by_curve(df, 4).count() == 20
    assert license_scan.license_scan(df).count() == 20
    assert lm_scoring.lm_scores(df, F.col("doc_id") % 2 == 0).count() == 20
    assert quality_classifier.score(df, np.zeros((1 << quality_classifier.BITS) + 1, np.float32)).count() == 20
    assert decontamination.decontaminate(df, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 20
