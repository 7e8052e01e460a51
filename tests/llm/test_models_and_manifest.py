"""Toxicity, centroid clustering and Merkle manifest against brute force, oracle SQL and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import centroid_clustering, merkle_manifest, queries, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


# 11


def spoken(seed, n, bad=("vile", "Scum", "vile scum")):
    """(text, label): invented prose; toxic texts have a bad word in twelve."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(150)] + ["Öl", "É!"]
    out = []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(12, 60))
        if i % 3 == 0:
            for _ in range(max(1, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((" ".join(w), int(i % 3 == 0)))
    return [*out, *out[:4], (None, 0), ("", 1), (" ,. ", 0), (" ".join(rng.choices(vocab, k=5000)), 0)]


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def plain_models(rows):
    """The models over dictionaries: word -> log probabilities of both classes; rest; pair -> logs; context -> weights."""
    d, least, ratio = toxicity.DISCOUNT, toxicity.LEAST, toxicity.RATIO
    seen = {0: set(), 1: set()}
    for text, label in rows:
        w = words_of(text)
        for i, x in enumerate(w):
            seen[label].add((w[i - 2] if i > 1 else "^", w[i - 1] if i else "^", x))
    two = [Counter((u, w) for _, u, w in seen[c]) for c in (0, 1)]
    one = [Counter(w for _, w in two[c]) for c in (0, 1)]
    shared = Counter(w for _, w in set(two[0]) | set(two[1]))
    total, types = [sum(c.values()) for c in one], [len(c) for c in one]
    first = lambda c, w: (max(one[c][w] - d, 0) + d * types[c] * shared[w] / sum(shared.values())) / total[c]
    kept = [w for w in shared if one[0][w] + one[1][w] >= least and abs(math.log(first(1, w) / first(0, w))) >= math.log(ratio)]
    of_kept = sum(shared[w] for w in kept)
    p1 = {w: [(max(one[c][w] - d, 0) + d * len(kept) * shared[w] / of_kept) / total[c] for c in (0, 1)] for w in kept}
    rest = [1 - sum(p[c] for p in p1.values()) for c in (0, 1)]
    by = [defaultdict(Counter), defaultdict(Counter)]
    for c in (0, 1):
        for (u, w), n in two[c].items():
            by[c][u][w] = n
    pairs, back = {}, {}
    for u, w in set(two[0]) | set(two[1]):
        if two[0][u, w] + two[1][u, w] >= least:
            low = p1.get(w, rest)
            p = [(max(two[c][u, w] - d, 0) + d * len(by[c][u]) * low[c]) / sum(by[c][u].values()) if by[c][u] else low[c] for c in (0, 1)]
            if abs(math.log(p[1] / p[0]) - math.log(low[1] / low[0])) >= math.log(ratio):
                pairs[u, w] = p
    for u in {u for u, _ in pairs}:
        own = [w for x, w in pairs if x == u]
        back[u] = [(1 - sum(pairs[u, w][c] for w in own)) / (1 - sum(p1[w][c] for w in own if w in p1)) for c in (0, 1)]
    return p1, rest, pairs, back


def plain_means(models, text):
    p1, rest, pairs, back = models
    w, sums = words_of(text), [0.0, 0.0]
    for u, x in zip(["^", *w], w):
        p = pairs.get((u, x)) or [a * b for a, b in zip(back.get(u, (1, 1)), p1.get(x, rest), strict=True)]
        sums = [s + math.log(v) for s, v in zip(sums, p, strict=True)]
    return len(w), *(s / max(len(w), 1) for s in sums)


@pytest.mark.parametrize("ratio", [10.0, 1.2])
def test_toxicity_models_against_dictionaries(spark, monkeypatch, ratio):
    monkeypatch.setattr(toxicity, "RATIO", ratio)
    monkeypatch.setattr(toxicity.smoothed, "__defaults__", (toxicity.LEAST, ratio))
    rows = spoken(1, 300)
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int").repartition(5))
    plain = plain_models(rows)
    assert len(model.words) == len(plain[0]) > 1 and len(model.pairs) == len(plain[2])
    assert plain[2]
    asked = spoken(2, 60)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)], "doc_id long, text string").repartition(3)
    for r in toxicity.compared(df, model).collect():
        n, ordinary, toxic = plain_means(plain, asked[r.doc_id][0])
        assert r.n_words == n and (r.ordinary, r.toxic) == (pytest.approx(ordinary, abs=1e-9), pytest.approx(toxic, abs=1e-9))


def test_toxicity_models_are_distributions(spark):
    """Over kept words and the rest, and over them below a context, probabilities sum to one."""
    model = toxicity.train(spark.createDataFrame(spoken(3, 300), "text string, label int"))
    assert np.exp(model.word_log).sum(axis=0) + np.exp(model.rest) == pytest.approx([1, 1])
    every = np.append(model.words, np.uint64(5))  # 5 stands for all other words
    for u in [*model.contexts[:5].tolist(), 17]:
        p = np.exp(toxicity.log_likelihoods(model, every, np.full(len(every), u, np.uint64)))
        other = toxicity._found(every, np.array([], np.uint64))
        assert len(other) == 0 and (p.sum(axis=0) <= 1 + 1e-9).all()


def test_toxicity_finds_planted_words(spark):
    rows = spoken(4, 900)
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, label int").repartition(4)
    out = toxicity.toxicity(df, df.filter("doc_id % 2 = 0")).join(df, "doc_id").filter("doc_id % 2 = 1 and n_words > 0").collect()
    assert np.mean([(r.score >= 0.7) == (r.label == 1) for r in out]) > 0.98


def test_toxicity_edges(spark):
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, None, None, "x"), (None, "", 5, "x"), (3, "vile", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    for labelled in (df, df.filter("label = 1"), df.limit(0)):
        got = toxicity.toxicity(df, labelled).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got} == {0.5}
    assert toxicity.toxicity(df.limit(0), df).count() == 0


@needs_tables
def test_toxicity_query_on_held_out_rows(spark):
    out = toxicity.op11_toxicity(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02 and np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.7


# 12


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(k, tuple(math.floor(64 * x) for x in v)) for k, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0], r[1]))
    cents = [list(v) for _, v in first[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for i in range(len(cents)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == i]
            if own:
                cents[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(k, near(v)) for k, v in kept]
    inertia = Counter()
    for _, (d, i) in found:
        inertia[i] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((k is None, k or 0, i, d, inertia[i], sum(inertia.values()), sha[i]) for k, (d, i) in found)


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=64) * (0.05 + (i % 4) * np.linspace(0.4, 0.01, 64))).astype(np.float32).tolist()) for i in range(n)]
    odd = [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [1.0] * 65), (n + 4, [None] + [0.0] * 63), (n + 5, [math.nan] + [0.0] * 63), (n + 6, [0.0] * 63 + [-math.inf])]
    return rows + odd + [(None, [0.5] * 64), (n + 7, [-0.0] * 64), rows[0], rows[0], (n + 8, rows[1][1])] if n else odd


@pytest.mark.parametrize("n", [200, 6, 0])
def test_clusters_against_brute_force(spark, n):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).repartition(3)
    got = centroid_clustering.cluster(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain_clusters([(k, v and [None if x is None else float(x) for x in v]) for k, v in rows])


def test_partial_distances_are_exact_and_leave_work_out():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-40, 40, (500, 64)), np.zeros((3, 64), np.int64)]) * np.linspace(3, 0.2, 64).round(1)
    x = np.floor(x).astype(np.int64)
    cents = np.concatenate([x[:12], x[:2], x[20:22]])  # two of them twice: ties go to the smaller number
    whole = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    which, best, work = centroid_clustering.nearest(x, cents, np.argsort(-x.var(axis=0)))
    assert (which == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()
    assert work < 0.8 * x.size * len(cents)
    back = centroid_clustering.nearest(x, cents, np.argsort(x.var(axis=0)))
    assert (back[0] == which).all() and back[2] > work  # the other order costs more and finds the same


def test_huge_components_count_as_the_bound(spark):
    df = spark.createDataFrame([(i, [3e38 if i % 2 else -3e38] * 64) for i in range(4)], "vec_id long, embedding array<float>")
    got = centroid_clustering.cluster(df).collect()
    assert len(got) == 4 and {r.distance for r in got} == {0}


# 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """(root, proofs): for each leaf its siblings as (left, right), level by level."""
    proofs, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, up_owners = [], []
        for a in range(0, len(level), 16):
            run = level[a : a + 16]
            for j in range(len(run)):
                for o in owners[a + j]:
                    proofs[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha(*run))
            up_owners.append([o for own in owners[a : a + 16] for o in own])
        level, owners = up, up_owners
    return level[0], proofs


def plain_manifest(rows):
    """By source: (doc_id, leaf, subroot, root, proof)."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, sha(*(value(x) for x in (r[0], r[3], r[2], r[4], r[1]))), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([made[s][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for x, proof in zip(sorted(by[s], key=lambda x: x[:3]), made[s][1], strict=True):
            out.append((x[3], x[2], made[s][0], root, sha(*(a + b for a, b in proof + above[i]))))
    return out


def documents(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 20 + [None, "", "-", "Ä", "z", f"one-{i}"])
        rows.append((None if i % 37 == 0 else i // 2, rng.choice([None, "", "Text É " * (i % 5), f"A{i}"]), rng.choice(["en", None]), source, rng.choice([None, i])))
    return rows + rows[:5] + rows[7:8] * 20 + [(10**6, "Long " * 40_000, "en", "hot", 1)]


@pytest.mark.parametrize("n", [700, 1])
def test_manifest_against_brute_force(spark, n):
    rows = documents(n, n)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "tree": F.lit("y"), "root": F.lit(1)}).repartition(6)
    got = merkle_manifest.manifest(df, merkle_manifest.COLUMNS).withColumn("proof", merkle_manifest.proof_digest(F.col("path"))).withColumn("again", merkle_manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(map(str, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got))) == sorted(map(str, plain_manifest(rows)))
    assert {r.again == r.root for r in got} == {True}


def test_manifest_edges(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], SCHEMA), merkle_manifest.COLUMNS).count() == 0
    one = merkle_manifest.manifest(spark.createDataFrame([(None, None, None, None, None)], SCHEMA), merkle_manifest.COLUMNS).collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in one] == [(sha("-----"),) * 3 + ([],)]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300, 5000])
def test_forests_merge_in_any_order(n):
    """However leaves are dealt to forests, and forests to each other, the same runs and root come out."""
    leaves = [sha(str(i)) for i in range(n)]
    for seed in range(3):
        rng = random.Random(seed)
        forests, out = [merkle_manifest.Forest() for _ in range(1 + seed * 3)], []
        for i in rng.sample(range(n), n):
            out += rng.choice(forests).add(0, "t", n, 0, i, leaves[i])
        while len(forests) > 1:
            a, b = rng.sample(range(len(forests)), 2)
            out += forests[a].merge(forests[b])
            del forests[b]
        assert not forests[0].open
        roots = [x for x in out if x[1] == "root"]
        assert len(roots) == 1 and roots[0][6] == [tree(leaves)[0]]
        assert sum(x[1] == "run" for x in out) == sum(-(-n // 16**k) for k in range(1, 9) if n > 16 ** (k - 1))


@needs_tables
def test_manifest_query_tells_what_was_changed(spark):
    got = merkle_manifest.op13_merkle_manifest(spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len({r.root for r in got}) == 1 and len(got) == len(text)
    for r in got:
        same = zlib.crc32(str(r.doc_id).encode()) % 5 or not re.search("[A-Z]", text[r.doc_id] or "")
        assert r.verified == bool(same) == (r.folded_root == r.root)


@needs_tables
@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_merkle_manifest"])
def test_queries_match_sql_on_larger_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(queries.SQL[name])
    at = [list(want.columns).index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
