"""Templates (watermark masks) in long form (field, p, v): learning, weights, correlation, thresholds, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import sized, stored
from .order_stats import cumulated, holds

#: Parts of a pixel's rows where masks are too many to be broadcast.
SALTS = 32


def learn(fields: DataFrame, *by: str) -> DataFrame:
    """([by,] p, n, total, squares): mergeable sums of each pixel, for all groups in one pass."""
    return fields.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))


def extend(mask: DataFrame, more: DataFrame) -> DataFrame:
    """Sums of both; the same as learning from all fields at once."""
    return mask.unionByName(more).groupBy("p").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def upper_median(c: Column) -> Column:
    """Element n div 2 of the sorted values."""
    s = F.array_sort(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def pattern(mask: DataFrame, *by: str) -> DataFrame:
    """([by,] p, pattern, variance, weight): centred means, clamped population variances, weights typical / (typical + variance). Groups must not be null."""
    mean = F.col("total") / F.col("n")
    m = mask.select(*by, "p", mean.alias("mean"), F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))
    whole = m.groupBy(*by).agg(F.avg("mean").alias("centre"), F.greatest(upper_median(F.col("variance")), F.lit(1e-6)).alias("typical"))  # a row for each group
    out = m.join(whole, list(by)) if by else m.crossJoin(F.broadcast(whole))
    return out.select(*by, "p", (F.col("mean") - F.col("centre")).alias("pattern"), "variance", (F.col("typical") / (F.col("typical") + F.col("variance"))).alias("weight"))


def correlation(a: Column, b: Column, w: Column) -> Column:
    """Weighted Pearson correlation of a group within -1..1 in one pass; 0 where it is not defined."""
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    cov, va, vb = F.sum(w * a * b) - sa * sb / n, F.sum(w * a * a) - sa * sa / n, F.sum(w * b * b) - sb * sb / n
    return F.when((n > 0) & (va > 1e-12) & (vb > 1e-12), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(va * vb)))).otherwise(F.lit(0.0))


def match(fields: DataFrame, masks: DataFrame) -> DataFrame:
    """(field, mask, value) of every field against every mask (mask, p, pattern, weight).

    Masks of a counted size are broadcast; beyond it rows meet by pixel and a salt of their field, so that pixels, of which there are few, are not the only keys.
    """
    masks = stored(masks, "masks")
    small = sized(masks)
    if small is masks:
        salted = masks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = fields.withColumn("_salt", F.pmod(F.xxhash64("field"), F.lit(SALTS)).cast("int")).join(salted, ["p", "_salt"])
    else:
        both = fields.join(small, "p")
    return both.groupBy("field", "mask").agg(correlation(F.col("pattern"), F.col("v"), F.col("weight")).alias("value"))


def contributions(fields: DataFrame, masks: DataFrame, least: float = 1e-9) -> DataFrame:
    """(field, mask, p, share): what each pixel adds to the correlation of a field with a mask; the shares of a pair sum up to it, before it is bounded by -1 and 1.

    No rows where the weights or the spread of either side are below `least`.
    """
    masks = stored(masks.select("mask", "p", "pattern", "weight"), "masks")
    small = sized(masks)
    both = fields.select("field", "p", "v").repartition("field").join(small, "p")
    a, b, w = F.col("pattern"), F.col("v"), F.col("weight")
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    spread = F.sqrt(F.greatest(F.sum(w * a * a) - sa * sa / n, F.lit(0.0))) * F.sqrt(F.greatest(F.sum(w * b * b) - sb * sb / n, F.lit(0.0)))
    whole = both.groupBy("field", "mask").agg(n.alias("_n"), (sa / n).alias("_a"), (sb / n).alias("_b"), spread.alias("_spread")).filter((F.col("_n") >= least) & (F.col("_spread") >= least))
    # Beside small masks all pixels of a field stay in their partition, so sums meet pixels without another shuffle.
    return both.join(whole.hint("merge" if small is masks else "shuffle_hash"), ["field", "mask"]).select("field", "mask", "p", (w * (a - F.col("_a")) * (b - F.col("_b")) / F.col("_spread")).alias("share"))


def best_match(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(field, mask, value, hit): the mask with the best ratio of value to its own threshold (ties: least mask)."""
    v = values.join(sized(stored(thresholds, "mask-thresholds")), "mask")
    best = v.groupBy("field").agg(F.max_by(F.struct("mask", "value", "threshold"), F.struct(F.col("value") / F.col("threshold"), -F.col("mask"))).alias("m"))
    return best.select("field", F.col("m.mask").alias("mask"), F.col("m.value").alias("value"), (F.col("m.value") >= F.col("m.threshold")).alias("hit"))


def _without(rows: DataFrame, *by: str) -> DataFrame:
    """([by,] field, value): correlation of each field with a mask less the field itself, from rows ([by,] field, p, v, n, total, squares)."""
    v = F.col("v")
    out = rows.withColumn("n", F.col("n") - 1).withColumn("total", F.col("total") - v).withColumn("squares", F.col("squares") - v * v)
    mean = F.col("total") / F.col("n")
    out = out.withColumn("mean", mean).withColumn("variance", F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    typical = out.groupBy(*by, "field").agg(F.greatest(upper_median(F.col("variance")), F.lit(1e-6)).alias("typical"), F.avg("mean").alias("centre"))
    out = out.join(typical, [*by, "field"])
    weight = F.col("typical") / (F.col("typical") + F.col("variance"))
    return out.groupBy(*by, "field").agg(correlation(F.col("mean") - F.col("centre"), v, weight).alias("value"))


def leave_one_out(fields: DataFrame, *by: str) -> DataFrame:
    """([by,] field, value): correlation of each field with the mask of all others of its group, whose sums are the totals less its own. The totals are a row for each group and pixel."""
    return _without(fields.select(*by, "field", "p", "v").join(sized(stored(learn(fields, *by), "mask-totals")), [*by, "p"]), *by)


def assigned(fields: DataFrame, masks: DataFrame, sums: DataFrame, share: float = 0.6, floor: float = 0.10, least: int = 5, measured: int = 6) -> DataFrame:
    """(folder, mask, way, worth, accepted): the mask of a catalogue that each folder of images belongs to; folders that fit none have no row.

    fields: (folder, field, mode, area, p, v), masks: (mask, mode, area, n, threshold, separability), sums: (mask, p, total, squares). A field is
    made once for each mode and area and meets all masks of that group. A group of a folder needs `least` fields.

    - way "share": among proven masks the one that most fields of the folder match, by the mask's threshold (or `floor`), if that is `share` of them at least.
    - way "gain": else, among weak masks that were measured, the one whose separability would be best if it were extended by the
      folder: the sums of both are added, and each field is held against them less itself. Extensions of fewer than `measured` fields in all are worth nothing.

    Ties go to the smaller mask. accepted tells whether the extension passes gate(); null where a proven mask is extended, which needs extended().
    """
    counts = fields.select("folder", "mode", "area", "field").distinct().groupBy("folder", "mode", "area").agg(F.count(F.lit(1)).alias("fields")).filter(F.col("fields") >= least)
    known = masks.select("mask", "mode", "area", F.col("n").alias("old_n"), "threshold", "separability")
    pairs = stored(counts.join(known, ["mode", "area"]), "assign-pairs")
    proof = is_proven(F.col("separability"))
    # Proven masks: how many fields match.
    shown = pattern(sums.join(known.filter(proof).select("mask", F.col("old_n").alias("n")), "mask"), "mask").join(known.select("mask", "mode", "area"), "mask")
    kinds = fields.join(shown.select("mask", "mode", "area", "p", "pattern", "weight"), ["mode", "area", "p"])
    values = kinds.groupBy("folder", "mask", "field").agg(correlation(F.col("pattern"), F.col("v"), F.col("weight")).alias("value"))
    limit = F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(floor)
    shares = values.join(pairs.select("folder", "mask", "threshold"), ["folder", "mask"]).groupBy("folder", "mask").agg(F.avg((F.col("value") >= limit).cast("double")).alias("worth")).filter(F.col("worth") >= share)
    # Weak masks: what they would be with the folder.
    grown = extended(fields, pairs.filter(~proof & (F.col("separability") > 0)), sums, measured).filter("after > 0")
    ways = shares.select("folder", "mask", F.lit("share").alias("way"), "worth", F.lit(None).cast("boolean").alias("accepted")).unionByName(grown.select("folder", "mask", F.lit("gain").alias("way"), F.col("after").alias("worth"), "accepted"))
    best = ways.groupBy("folder").agg(F.max(F.struct((F.col("way") == "share").alias("first"), "worth", (-F.col("mask")).alias("neg"), "accepted")).alias("b"))
    return best.select("folder", (-F.col("b.neg")).alias("mask"), F.when(F.col("b.first"), "share").otherwise("gain").alias("way"), F.col("b.worth").alias("worth"), F.col("b.accepted").alias("accepted"))


def extended(fields: DataFrame, pairs: DataFrame, sums: DataFrame, measured: int = 6) -> DataFrame:
    """(folder, mask, before, after, n, accepted): each pair's mask if it were extended by the folder's fields of its mode and area.

    pairs: (folder, mask, mode, area, fields, old_n, separability). after is the upper median of the fields' correlations with the joint sums less themselves; 0 below `measured` fields in all.
    """
    new = learn(fields, "folder", "mode", "area").drop("n")
    joint = pairs.join(new, ["folder", "mode", "area"]).join(sums.select("mask", "p", F.col("total").alias("_t"), F.col("squares").alias("_s")), ["mask", "p"])
    joint = joint.select("folder", "mask", "mode", "area", "p", (F.col("old_n") + F.col("fields")).alias("n"), (F.col("total") + F.col("_t")).alias("total"), (F.col("squares") + F.col("_s")).alias("squares"))
    rows = fields.join(joint, ["folder", "mode", "area", "p"]).select("folder", "mask", "field", "p", "v", "n", "total", "squares")
    after = _without(rows, "folder", "mask").groupBy("folder", "mask").agg(upper_median(F.col("value")).alias("_value"))
    out = pairs.withColumn("n", F.col("old_n") + F.col("fields")).join(after, ["folder", "mask"])
    after = F.when(F.col("n") >= measured, F.col("_value")).otherwise(0.0)
    return out.select("folder", "mask", F.col("separability").alias("before"), after.alias("after"), "n", gate(F.col("separability"), F.col("old_n"), after, F.col("n")).alias("accepted"))


def threshold(values: DataFrame, *by: str, share: float = 0.75, low: float = 0.10, high: float = 0.9) -> DataFrame:
    """([by,] threshold, separability), a row for each group: threshold from the value at 10 % of the sorted ones, separability from the one at half; none without values."""
    at = lambda q: F.max(F.when(holds(F.floor(F.col("total") * q)), F.col("value")))
    out = cumulated(values, "value", *by).groupBy(*by).agg(at(0.10).alias("tenth"), at(0.5).alias("separability")).filter("tenth is not null")
    return out.select(*by, F.least(F.lit(high), F.greatest(F.lit(low), F.col("tenth") * share)).alias("threshold"), "separability")


def largest_gap(values: DataFrame, *by: str, trim: float = 0.10) -> DataFrame:
    """([by,] gap, cut, below), a row for each group: the widest gap between neighbouring values within the middle, where it is cut, and how many values lie below; the first of equal gaps."""
    lo, hi = F.floor(F.col("total") * trim), F.floor(F.col("total") * (1 - trim)) - 1
    last = F.col("before") + F.col("n") - 1
    first = F.greatest(F.col("before"), lo)
    # The last of equal values has the gap to the next value; those before it have none.
    gap = lambda size, at, cut: F.struct(size.alias("gap"), (-at).alias("at"), cut.alias("cut"))
    wide = F.when(F.col("next").isNotNull() & last.between(lo, hi), gap(F.col("next") - F.col("value"), last, (F.col("next") + F.col("value")) / 2))
    none = F.when(first <= F.least(last - 1, hi), gap(F.col("value") - F.col("value"), first, F.col("value")))
    best = cumulated(values, "value", *by).groupBy(*by).agg(F.max(F.greatest(wide, none)).alias("b")).filter("b is not null")
    return best.select(*by, "b.gap", "b.cut", (1 - F.col("b.at")).cast("long").alias("below"))


def images_needed(separability: Column, n: Column, proven: float = 0.15) -> Column:
    """n (proven / separability)^2, null beyond 1000, rounded up to tens below 100 and to fifties from there."""
    need = n * F.pow(proven / separability, F.lit(2.0))
    rounded = F.when(need <= 100, F.ceil(need / 10) * 10).otherwise(F.ceil(need / 50) * 50)
    return F.when((separability > 0) & (need <= 1000), rounded.cast("long"))


def gate(old: Column, old_n: Column, new: Column, new_n: Column, proven: float = 0.15, ratio: float = 0.75) -> Column:
    """Whether an extension is accepted: a proven mask stays proven, and separability grows as noise would let it."""
    expected = old * F.sqrt(old_n / new_n)
    return F.when((old >= proven) & (new < proven), F.lit(False)).otherwise(F.coalesce(new / expected >= ratio, F.lit(False)))


def catalogue_sums(masks: DataFrame) -> DataFrame:
    """One row: masks, fields they were learnt from, and how many are proven."""
    return masks.agg(F.count(F.lit(1)).alias("masks"), F.coalesce(F.sum("n"), F.lit(0)).alias("fields"), F.count_if(is_proven(F.col("separability"))).alias("proven"))


def high_share(values: DataFrame, *by: str, q: float = 0.98) -> DataFrame:
    """([by,] value): the value at `q` of the sorted positive ones, for scaling maps that few outliers must not flatten."""
    ranked = cumulated(values.filter("value > 0"), "value", *by)
    return ranked.filter(holds(F.least(F.floor(F.col("total") * q), F.col("total") - 1))).select(*by, "value")


def usable(separability: Column) -> Column:
    """Masks that were ever measured take part in a check, weak ones too."""
    return separability.isNotNull()


def is_proven(separability: Column, proven: float = 0.15) -> Column:
    return F.coalesce(separability >= proven, F.lit(False))


def split(fields: DataFrame, least: int = 12, side: int = 5, apart: float = 0.10) -> DataFrame:
    """(field, upper): fields cut in two where their match with the common mask has its widest gap; no rows unless both halves are proven.

    A half needs `side` fields, and must match its own mask (without the field itself) better than the other half's
    by `apart` on average. All fields of a half are measured.
    """
    one = lambda part: pattern(learn(part)).withColumn("mask", F.lit(0))
    values = stored(match(fields, one(fields)).select("field", "value"), "split-values")
    gap = largest_gap(values).filter("gap > 0").select("cut")  # one row
    halves = values.crossJoin(F.broadcast(gap)).select("field", (F.col("value") > F.col("cut")).alias("upper"))
    dealt = stored(fields.select("field", "p", "v").join(halves, "field"), "split-halves")
    up, low = dealt.filter("upper").drop("upper"), dealt.filter("not upper").drop("upper")
    proof = None
    for k, (own, other) in enumerate(((up, low), (low, up))):
        loo = leave_one_out(own).agg(F.avg("value").alias(f"own{k}"), F.count(F.lit(1)).alias(f"n{k}"))
        foreign = match(own, one(other)).agg(F.avg("value").alias(f"foreign{k}"))
        row = loo.crossJoin(F.broadcast(foreign))  # one row each
        proof = row if proof is None else proof.crossJoin(F.broadcast(row))
    kept = proof.filter(f"n0 >= {side} and n1 >= {side} and n0 + n1 >= {least} and own0 - foreign0 >= {apart} and own1 - foreign1 >= {apart}")
    return dealt.select("field", "upper").distinct().crossJoin(F.broadcast(kept.select(F.lit(1).alias("_ok")))).drop("_ok")


def folder_check(values: DataFrame, masks: DataFrame, hints: DataFrame) -> DataFrame:
    """(field, mask, value, visible, metadata): the best usable mask of each image and whether its metadata hint at a generator.

    masks (mask, threshold, separability); hints (field). Images with hints alone have no mask.
    """
    best = best_match(values, masks.filter(usable(F.col("separability"))).select("mask", "threshold"))
    marked = hints.select("field").distinct().withColumn("_hint", F.lit(True))
    out = best.join(marked, "field", "full")
    return out.select("field", "mask", "value", F.coalesce("hit", F.lit(False)).alias("visible"), F.coalesce("_hint", F.lit(False)).alias("metadata"))
