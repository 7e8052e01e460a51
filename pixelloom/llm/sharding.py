"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of cells given as integers in [0, 2**bits).

    The published transform (exchange and invert lower bits from the top level down, then Gray
    code), folded over the levels with aggregate() so that the expression stays small.
    """
    n = len(dims)
    start = F.array(*(d.cast("long") for d in dims))

    def swapped(x: Column, i: int, q: Column, p: Column) -> list[Column]:
        """Bit q of x[i] set: invert the lower bits of x[0]; clear: exchange them between x[0] and x[i]."""
        head, own = F.element_at(x, 1), F.element_at(x, i + 1)
        swap, hit = head.bitwiseXOR(own).bitwiseAND(p), own.bitwiseAND(q) != 0
        parts = [F.element_at(x, j + 1) for j in range(n)]
        parts[i] = F.when(hit, own).otherwise(own.bitwiseXOR(swap))
        parts[0] = F.when(hit, head.bitwiseXOR(p)).otherwise(head.bitwiseXOR(swap))
        return parts

    def level(x: Column, q: Column) -> Column:
        p = q - 1
        for i in range(n):
            # A one-element transform names the intermediate array, which keeps the tree linear in size.
            x = F.element_at(F.transform(F.array(x), lambda y: F.array(*swapped(y, i, q, p))), 1)
        return x

    tops = F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1))) if bits > 1 else F.array().cast("array<bigint>")
    turned = F.aggregate(tops, start, level)

    def gray(x: Column) -> Column:
        parts = [F.element_at(x, 1)]
        for j in range(1, n):
            parts.append(F.element_at(x, j + 1).bitwiseXOR(parts[-1]))
        last = parts[-1]
        t = F.aggregate(tops, F.lit(0).cast("long"), lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return F.transform(F.array(*parts), lambda v: v.bitwiseXOR(t))

    coded = F.element_at(F.transform(F.array(turned), gray), 1)

    def interleaved(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for j in range(n):
                out = F.shiftleft(out, 1) + F.shiftright(F.element_at(x, j + 1), b).bitwiseAND(F.lit(1).cast("long"))
        return out

    return F.element_at(F.transform(F.array(coded), interleaved), 1)


def _in_order(df: DataFrame, *order: Column, name: str) -> tuple[DataFrame, dict[int, int]]:
    """df in a range-partitioned sort, written with _part and _place (from 0 within the part); and the rows of every part."""
    mono = F.monotonically_increasing_id()
    placed = stored(df.orderBy(*order).withColumn("_part", F.shiftright(mono, 33)).withColumn("_place", mono.bitwiseAND(F.lit((1 << 33) - 1))), name)
    return placed, {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition


def _starts(spark, sizes: dict[int, int], column: str) -> DataFrame:
    """(_part, column): the sum over the parts before, a row for each partition."""
    before, total = [], 0
    for part, n in sorted(sizes.items()):
        before.append((part, total))
        total += n
    return spark.createDataFrame(before, f"_part long, {column} long")


def string_cuts(docs: DataFrame, value: Column, cells: int) -> list[str]:
    """At most cells - 1 whole values that cut the order of strings into cells of like weight.

    A value weighs its rows, but no more than a cell's share, so a hot value does not take the cells of the others.
    Values are counted, sorted and summed up by Spark; only the cuts and a row for each partition come to the driver.
    """
    counts = stored(docs.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v is not null"), "curve-values")
    most = counts.agg(F.sum("n").alias("n")).first()["n"]
    if not most:
        return []
    placed, _ = _in_order(counts.withColumn("n", F.least("n", F.lit(-(-most // cells)))), F.col("v"), name="curve-sorted")
    sums = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    total = sum(sums.values())
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_start")
    celled = placed.join(F.broadcast(_starts(docs.sparkSession, sums, "_start")), "_part").withColumn("_cell", F.expr("0L") + F.floor(before * cells / total))
    return sorted(r["v"] for r in celled.groupBy("_cell").agg(F.min("v").alias("v")).collect())[1:]  # at most `cells` rows


def _cell(value: Column, cuts: list, kind: str) -> Column:
    """Number of cuts that are not above the value; 0 for null."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)).cast(f"array<{kind}>"), lambda x: x <= value)), F.lit(0))


def with_curve(docs: DataFrame, dims: dict[str, Column], bits: int = 5) -> DataFrame:
    """Adds `curve`. Each dimension is cut into 2**bits cells that hold like numbers of rows: numbers at their approximate quantiles, strings by their order as whole values (a hot value counts as one cell). Null is the lowest value."""
    cells = 1 << bits
    named = {f"_d{i}": c for i, c in enumerate(dims.values())}
    out = docs.withColumns(named)
    texts = [k for k, t in out.select(*named).dtypes if t == "string"]
    numbers = [k for k in named if k not in texts]
    steps = F.array(*(F.lit(i / cells) for i in range(1, cells)))
    found = out.agg(*(F.percentile_approx(F.coalesce(F.col(k).cast("double"), F.lit(-1.0)), steps, F.lit(2000)).alias(k) for k in numbers)).first() if numbers else {}
    quantised = []
    for k in named:
        if k in texts:
            quantised.append(_cell(F.col(k), string_cuts(out, F.col(k), cells), "string"))
        else:
            quantised.append(_cell(F.coalesce(F.col(k).cast("double"), F.lit(-1.0)), sorted(set(found[k] or [])), "double"))
    return out.withColumn("curve", hilbert_index(quantised, bits)).drop(*named)


def shard_by_curve(docs: DataFrame, n_shards: int = 40, text: str = "text", key: str = "doc_id", dims: dict[str, Column] | None = None, bits: int = 5) -> DataFrame:
    """One slim row per document: key, size, text_crc32, curve, shard and slot, shards being equal runs of the curve.

    Law `rows`: the rows of two shards differ by one at most, and slots count from 0 without gaps.
    Ties on the curve go by text checksum (so equal texts are neighbours), then key. A global rank
    comes from a range-partitioned sort: rows of earlier partitions plus the place in the own one; no
    task sees more than its range. Null texts have size 16, null sources and
    languages come first, null keys last; rows equal in all of this are interchangeable; an empty table has no shards. Only key, text and dimensions are looked at. A text is only measured, so its length does not matter.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    if dims is None:
        dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.octet_length(body).cast("double")}
    cols = {"size": (F.octet_length(body) + 16).cast("long"), "text_crc32": F.crc32(body.cast("binary")).cast("long")}
    slim = with_curve(docs, dims, bits).select(F.col(key), F.col("curve"), *(v.alias(k) for k, v in cols.items()))
    placed, counts = _in_order(slim, F.col("curve"), F.col("text_crc32"), F.col(key).asc_nulls_last(), F.xxhash64(key, "size"), name="curve-order")
    starts, total = _starts(docs.sparkSession, counts, "_start"), sum(counts.values())
    n = max(total, 1)
    rank = F.col("_start") + F.col("_place")
    shard = F.expr(f"((_start + _place) * {n_shards}L) div {n}L")
    out = placed.join(F.broadcast(starts), "_part").withColumn("_rank", rank).withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")  # the least rank with this shard
    return out.withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_part", "_place", "_start", "_rank")


def op8_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_curve(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
