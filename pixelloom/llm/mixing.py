"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stored

SEED = 20
#: A quota is filled as soon as this share of its target, or less, is left.
NEAR = 0.0005
#: Plans have a row for each membership pattern; up to so many are broadcast, more are joined by a shuffle.
BROADCAST_PATTERNS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def water_filled(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Targets that share the sum of sizes by weight, none above `most` times its size; the excess goes on to the others by weight."""
    total, targets, fixed = float(sum(sizes)), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(t for t, f in zip(targets, fixed, strict=True) if f)
        share = sum(w for w, f in zip(weights, fixed, strict=True) if not f)
        over = []
        for i, w in enumerate(weights):
            if not fixed[i]:
                targets[i] = rest * w / share
                if targets[i] > most * sizes[i]:
                    over.append(i)
        if not over:
            return targets
        for i in over:
            targets[i], fixed[i] = most * sizes[i], True


def min_cost_flow(sizes: list[int], members: list[list[int]], quotas: list[int], epochs: int = 3) -> list[int]:
    """Tokens to take from each pattern. Pattern p supplies its size once for each epoch at cost 0, 1, 2, ... (convex: repeating costs more each time) to the sources in members[p].

    Only supply has a cost, so the cheapest flow is found cost level by cost level: as much as can be had without repeating, then
    with one repetition, and so on, each level by blocking flows along shortest augmenting paths. What a pattern supplies never
    shrinks; which of its sources gets it may change. Runs on the driver over patterns and sources, never over documents.
    """
    n_p = len(sizes)
    used, left, given = [0] * n_p, list(quotas), [[0] * len(m) for m in members]
    # For each source the patterns that hold it, with the source's place among the pattern's members.
    holders: list[list[tuple[int, int]]] = [[] for _ in quotas]
    for p, m in enumerate(members):
        for j, s in enumerate(m):
            holders[s].append((p, j))
    for level in range(1, epochs + 1):
        while True:
            # Layers, patterns at even and sources at odd depth: from patterns with supply to sources with room.
            depth_p, depth_s = [-1] * n_p, [-1] * len(quotas)
            layer = [p for p in range(n_p) if used[p] < level * sizes[p]]
            for p in layer:
                depth_p[p] = 0
            depth, reached = 0, False
            while layer and not reached:
                ahead = []
                for p in layer:
                    for s in members[p]:
                        if depth_s[s] < 0:
                            depth_s[s] = depth + 1
                            ahead.append(s)
                reached = any(left[s] > 0 for s in ahead)
                layer = []
                if not reached:
                    for s in ahead:
                        for p, j in holders[s]:
                            if depth_p[p] < 0 and given[p][j] > 0:
                                depth_p[p] = depth + 2
                                layer.append(p)
                depth += 2
            if not reached:
                break
            # One blocking flow: arcs that lead nowhere are passed over for good.
            next_p, next_s = [0] * n_p, [0] * len(quotas)
            for start in range(n_p):
                while depth_p[start] == 0 and used[start] < level * sizes[start]:
                    path: list[tuple[int, int]] = []  # (pattern, place of the source it gives to)
                    p, end = start, -1
                    while end < 0:
                        if next_p[p] < len(members[p]):
                            s = members[p][next_p[p]]
                            if depth_s[s] != depth_p[p] + 1:
                                next_p[p] += 1
                                continue
                            if left[s] > 0:
                                path.append((p, next_p[p]))
                                end = s
                                continue
                            while next_s[s] < len(holders[s]):
                                q, j = holders[s][next_s[s]]
                                if depth_p[q] == depth_s[s] + 1 and given[q][j] > 0:
                                    break
                                next_s[s] += 1
                            else:
                                next_p[p] += 1
                                continue
                            path.append((p, next_p[p]))
                            p = q
                        elif path:
                            p, j = path.pop()
                            next_s[members[p][j]] += 1
                        else:
                            break
                    if end < 0:
                        break
                    # Each source on the way but the last hands on what it had from the next pattern.
                    back = [holders[members[p][j]][next_s[members[p][j]]] for p, j in path[:-1]]
                    flow = min([level * sizes[start] - used[start], left[end], *(given[q][j] for q, j in back)])
                    for p, j in path:
                        given[p][j] += flow
                    for q, j in back:
                        given[q][j] -= flow
                    used[start] += flow
                    left[end] -= flow
    return used


def flows(sizes: list[int], members: list[list[int]], quotas: list[int], epochs: int = 3) -> list[int]:
    """min_cost_flow, with the patterns set apart whose sources are in no other pattern: their flow is plain."""
    uses = Counter(s for m in members for s in m)
    shared = [p for p, m in enumerate(members) if len(m) > 1 or any(uses[s] > 1 for s in m)]
    out = [min(epochs * n, sum(quotas[s] for s in m)) for n, m in zip(sizes, members, strict=True)]
    at = {s: i for i, s in enumerate(sorted({s for p in shared for s in members[p]}))}
    part = min_cost_flow([sizes[p] for p in shared], [[at[s] for s in members[p]] for p in shared], [quotas[s] for s in at], epochs)
    for p, f in zip(shared, part, strict=True):
        out[p] = f
    return out


def _ordered(names: set) -> list:
    """Sources by code point, null last."""
    return sorted(names, key=lambda x: (x is None, x or ""))


def place(docs: DataFrame, seed: int = SEED) -> Column:
    """Seeded place of a row, from 0 to 2**62 - 1: a hash of the whole row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *docs.columns), 2)


def mix(docs: DataFrame, members: Column, size: Column, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = SEED) -> DataFrame:
    """Every input row with size, source_size, target (of its first source), copies and taken = copies * size.

    members: array of the sources that a row belongs to (a null element is a source, last in order).
    Weights repeat over the sources by code point. Documents are aggregated by membership pattern, the
    flow gives each pattern its tokens. A pattern takes all its documents as often as that fills; what is left is a gap that
    whole documents fill in seeded order: as far as they fit, then again those that still fit into what
    is left, until that is next to nothing or no document fits; then one more document if that comes nearer.

    Rows are placed by a hash of all their columns, so reruns and other partitions agree; only rows equal in every column are taken
    alike. Ties of place and size are taken together. A null array of sources is a pattern of its own that takes nothing. Documents of size 0 (null, empty and blank texts) and empty tables take nothing.
    Long texts are only counted. Input columns whose names begin with _mix_ are dropped; those named
    like an output column are replaced. The driver holds a row for each pattern, some 600 bytes.
    """
    spark = docs.sparkSession
    cols = {"_mix_place": place(docs, seed), "_mix_pattern": F.array_sort(F.array_distinct(members)), "size": size}
    tagged = docs.withColumns(cols)
    slim = stored(tagged.select(*cols), "mix-sizes")
    per = [(r["_mix_pattern"], int(r["n"])) for r in slim.groupBy("_mix_pattern").agg(F.sum("size").alias("n")).collect()]
    per.sort(key=lambda r: [(s is None, s or "") for s in r[0]])
    names = _ordered({s for r, _ in per for s in r})
    at = {s: i for i, s in enumerate(names)}
    member = [[at[s] for s in r] for r, _ in per]
    sizes = [n for _, n in per]
    of_source = [0] * len(names)
    for n, m in zip(sizes, member, strict=True):
        for i in m:
            of_source[i] += n
    targets = water_filled(of_source, [weights[i % len(weights)] for i in range(len(names))], most) if sum(sizes) else [0.0] * len(names)
    flow = flows(sizes, member, [round(t) for t in targets], most)
    gaps = [f % n if n else 0 for f, n in zip(flow, sizes, strict=True)]
    stops: list[list[tuple[int, int]]] = [[] for _ in per]  # documents up to this size are taken up to this place
    extra: list[int | None] = [None] * len(per)
    kind = slim.schema["_mix_pattern"].dataType.simpleString()

    def joined(df: DataFrame, rows: list, columns: str) -> DataFrame:
        plan = spark.createDataFrame(rows, f"_mix_of {kind}, _mix_stops array<struct<size: long, place: long>>, {columns}")
        plan = F.broadcast(plan) if len(rows) <= BROADCAST_PATTERNS else plan
        return df.join(plan, df["_mix_pattern"].eqNullSafe(plan["_mix_of"]), "left" if columns.startswith("source") else "inner").drop("_mix_of")

    taken = F.exists("_mix_stops", lambda x: (F.col("size") <= x["size"]) & (F.col("_mix_place") <= x["place"]))
    bucket = F.shiftright("_mix_place", 50)  # 4096 of them
    number = {tuple(r): i for i, (r, _) in enumerate(per)}
    goal = [max(NEAR * (targets[m[0]] if m else 0), 0) for m in member]
    open_ = [i for i, g in enumerate(gaps) if g > goal[i]]
    while open_:
        fits = joined(slim, [(per[i][0], stops[i], gaps[i]) for i in open_], "_gap long").filter((F.col("size") > 0) & (F.col("size") <= F.col("_gap")) & ~taken)
        sums = stored(fits.groupBy("_mix_pattern", "_gap", bucket.alias("_bucket")).agg(F.sum("size").alias("n")), "mix-buckets")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_mix_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The bucket in which the seeded order fills the gap, or the last one; then the last document in it that fits.
        edge = sums.withColumn("_before", before).filter(F.col("_before") <= F.col("_gap")).groupBy("_mix_pattern").agg(F.max_by(F.struct("_bucket", "_before"), "_bucket").alias("e")).collect()
        edges = [(r["_mix_pattern"], stops[number[tuple(r["_mix_pattern"])]], gaps[number[tuple(r["_mix_pattern"])]], r["e"]["_bucket"], r["e"]["_before"]) for r in edge]
        near = joined(slim, edges, "_gap long, _edge long, _before long").filter((F.col("size") > 0) & (F.col("size") <= F.col("_gap")) & ~taken & (bucket == F.col("_edge")))
        w = Window.partitionBy("_mix_pattern").orderBy("_mix_place").rangeBetween(Window.unboundedPreceding, 0)
        got = near.withColumn("_sum", F.col("_before") + F.sum("size").over(w)).filter(F.col("_sum") <= F.col("_gap")).groupBy("_mix_pattern").agg(F.max("_sum").alias("got"), F.max("_mix_place").alias("place"))
        last = {tuple(r["_mix_pattern"]): (r["got"], r["place"]) for r in got.collect()}  # a row for each pattern at most
        left = []
        for pattern, _, gap, edge_bucket, edge_before in edges:
            i = number[tuple(pattern)]
            n, until = last.get(tuple(pattern), (edge_before, (edge_bucket << 50) - 1))
            if n:
                stops[i].append((gap, until))
                gaps[i] -= n
                if gaps[i] > goal[i]:
                    left.append(i)
        open_ = left
    open_ = [i for i, g in enumerate(gaps) if g > goal[i]]
    if open_:
        over = joined(slim, [(per[i][0], stops[i], gaps[i]) for i in open_], "_gap long").filter((F.col("size") > 0) & (F.col("size") < 2 * F.col("_gap")) & ~taken)
        for r in over.groupBy("_mix_pattern").agg(F.min(F.struct("size", "_mix_place")).alias("m")).collect():  # a row for each pattern at most
            extra[number[tuple(r["_mix_pattern"])]] = r["m"]["_mix_place"]
    plan = [(r, stops[i], of_source[m[0]] if m else 0, float(targets[m[0]]) if m else 0.0, flow[i] // n if n else 0, extra[i]) for i, ((r, n), m) in enumerate(zip(per, member, strict=True))]
    out = joined(tagged.drop("source_size", "target"), plan, "source_size long, target double, _mix_full long, _mix_extra long")
    once = taken | F.coalesce(F.col("_mix_place") == F.col("_mix_extra"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("_mix_full") + once.cast("int")).otherwise(F.lit(0))
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("_mix_pattern", "_mix_place", "_mix_stops", "_mix_full", "_mix_extra")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs, F.array("source"), word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
