"""Repeated-string removal by prefix-free parsing: phrases from rolling-hash triggers, sorted by their suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, mixed, powers, stored

_BASE = 0xD6E8FEB86659FD93 | 1
_BASE2 = 0xA0761D6478BD642F | 1
_BYTE = mixed(np.arange(1001, 1257, dtype=np.uint64))
#: Dictionary entries of one trigger whose suffixes are sorted in one array; a trigger with more is dealt to several.
ENTRIES = 4096


def rolling_hash(data: np.ndarray, w: int) -> np.ndarray:
    """64-bit hash of the w bytes from each place, by doubling; w is a power of two."""
    h, k = _BYTE[data], 1
    while k < w:
        h = h[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + h[k:]
        k *= 2
    return mixed(h)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, w: int):
    """Cuts each text of a block at its triggers.

    The trigger of a string of `length` bytes is the leftmost place in it with the least hash of w
    bytes, so equal strings have equal triggers at equal distances, whatever stands around them. A
    phrase is the run of starts whose strings share one trigger; it reaches from its first start to
    `length` bytes after its last. Returns (document, first start, starts, trigger hash, hashes).
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h = rolling_hash(data, w)
    span = length - w + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    low, k = key, 1
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if span > k:
        low = np.minimum(low[: len(low) - (span - k)], low[span - k :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # trigger of the string that starts here
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    start = np.arange(len(doc)) + (offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0))[:-1]]))[doc]
    at = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return doc[first], start[first], count, h[at[first]], h


def spans_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of the places lo..hi-1 of a sequence of hashes, equal for equal runs wherever they stand."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(base, len(h))[: len(h)], out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), len(h) + 1)
    return mixed((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def _triggers_pass(length: int, w: int):
    """Trigger hash of every phrase, with how often it came in the batch."""

    def run(batches):
        for batch in batches:
            found = [phrases(data, offsets, length, w)[3] for _, offsets, data in blocks(batch.column(0))]
            if found:
                k, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "n"])

    return run


def _phrases_pass(length: int, w: int):
    """The parse: (k, e, id, lo, n, fresh) for every phrase, k and e being a digest of 128 bits of its whole reach; fresh: the text has no equal phrase before it."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, offsets, data in blocks(batch.column(1)):
                doc, start, count, k, h = phrases(data, offsets, length, w)
                if not len(doc):
                    continue
                e = spans_hash(h, start, start + count + length - w, _BASE)
                order = np.lexsort((e, k, doc))  # stable: equal phrases of a text stay in order
                a, b = order[1:], order[:-1]
                fresh = np.ones(len(doc), dtype=bool)
                fresh[a] = (doc[a] != doc[b]) | (k[a] != k[b]) | (e[a] != e[b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(e.view(np.int64)), ids.slice(first, len(offsets) - 1).take(pa.array(doc)), pa.array((start - offsets[doc]).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(fresh)], names=["k", "e", "id", "lo", "n", "fresh"]
                )

    return run


def _reaches_pass(length: int):
    """(id, lo, k, split, bytes): what the listed phrases of a text reach over, with their trigger and the number of arrays that its entries are dealt to."""

    def run(batches):
        for batch in batches:
            ids, texts, lists = batch.column("id"), batch.column("text"), batch.column("parts")
            def reached(rows, picked, out):
                part = lists.flatten().take(pa.array(picked, pa.int64()))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *(part.field(c) for c in ("lo", "k", "split")), pa.array(out, pa.binary())], names=["id", "lo", "k", "split", "reach"])

            rows, picked, out, before = [], [], [], 0
            for i in range(batch.num_rows):
                view = memoryview(texts[i].as_buffer())
                part = lists[i].values
                for j, (lo, n) in enumerate(zip(part.field("lo").to_numpy(), part.field("n").to_numpy(), strict=True)):
                    rows.append(i)
                    picked.append(before + j)
                    out.append(bytes(view[lo : lo + n + length - 1]))
                before += len(part)
                if len(out) > 20_000:
                    yield reached(rows, picked, out)
                    rows, picked, out = [], [], []
            if out:
                yield reached(rows, picked, out)

    return run


def _triggers_of(h: np.ndarray, offsets: np.ndarray, length: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the trigger, number of starts) of each reach: its least hash among the places that all of its strings cover."""
    count = np.diff(offsets) - length + 1
    key = np.append((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
    lo = offsets[:-1] + count - 1
    hi = offsets[:-1] + length - w + 1
    least = np.minimum.reduceat(key, np.stack([lo, hi], axis=1).ravel())[::2]
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), count


def _contexts_pass(length: int, w: int):
    """(c, id, lo, left, right): hashes of the trigger with g bytes before it (left = g) or after it (right = g), for g in quarters of what a string can reach."""
    steps = [round((length - w) * q / 4) for q in (1, 2, 3, 4)]

    def run(batches):
        for batch in batches:
            ids, lows = batch.column("id"), batch.column("lo")
            for first, offsets, data in blocks(batch.column("reach")):
                h = rolling_hash(data, w)
                at, _ = _triggers_of(h, offsets, length, w)
                for g in steps:
                    for side in (0, 1):
                        room = at - offsets[:-1] if side == 0 else offsets[1:] - at - w
                        row = np.flatnonzero(room >= g)
                        lo, hi = (at[row] - g, at[row] + 1) if side == 0 else (at[row], at[row] + g + 1)
                        c = spans_hash(h, lo, hi, _BASE if side == 0 else _BASE2)
                        took = pa.array(first + row)
                        size = [pa.array(np.full(len(row), v, np.int32)) for v in ((g, 0) if side == 0 else (0, g))]
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), ids.take(took), lows.take(took), *size], names=["c", "id", "lo", "left", "right"])

    return run


def suffix_array(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): the suffixes that start at `at`, sorted by their first `length` bytes and then by their number; head tells where a run of suffixes of one group that agree to that depth begins."""
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at])
    order = np.argsort(text.view(f"S{length}").ravel(), kind="stable")
    text, group = text[order], group[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (text[1:] != text[:-1]).any(axis=1) | (group[1:] != group[:-1])
    return order, head


def _suffix_arrays_pass(length: int, w: int):
    """(id, lo, hi, s1, s2): runs of starts whose strings are repeats, with what they cover; and, with the digest of their string, starts that only other arrays of the trigger can decide.

    Rows come sorted by (bucket, id, lo), so in a run of equal suffixes the first one comes first in the corpus. Only suffixes that
    reach less than a quarter step beyond the contexts which another phrase shares are sorted: others are no repeats.
    """
    span = length - w
    step = span - round(span * 3 / 4) + 1

    def decided(batch):
        ids, lows = batch.column("id"), batch.column("lo").to_numpy()
        left, right, split = (batch.column(c).to_numpy() for c in ("left", "right", "split"))
        bucket, place = batch.column("bucket").to_numpy(), batch.column("place").to_numpy()
        again = np.zeros(len(bucket), dtype=bool)  # rows equal in key and text are one text
        again[1:] = (bucket[1:] == bucket[:-1]) & (place[1:] == place[:-1])
        for _, offsets, data in blocks(batch.column("reach"), 1 << 40):
            h = rolling_hash(data, w)
            at, count = _triggers_of(h, offsets, length, w)
            row = np.repeat(np.arange(len(count)), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            before = at[row] - offsets[row] - inner
            keep = (before < left[row] + step) & (span - before < right[row] + step) & ~again[row]
            row, inner = row[keep], inner[keep]
            if not len(row):
                continue
            start = offsets[row] + inner
            order, head = suffix_array(data, start, bucket[row], length)
            later = np.sort(order[~head])
            first = np.ones(len(later), dtype=bool)
            first[1:] = (row[later[1:]] != row[later[:-1]]) | (inner[later[1:]] > inner[later[:-1]] + length)
            begin = later[first]
            end = later[np.append(np.flatnonzero(first)[1:] - 1, len(later) - 1)] if len(later) else later
            none = pa.nulls(len(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[begin])), pa.array(lows[row[begin]] + inner[begin]), pa.array(lows[row[end]] + inner[end] + length), none, none], names=["id", "lo", "hi", "s1", "s2"])
            open_ = order[head]
            open_ = open_[split[row[open_]] > 1]
            if len(open_):
                s1, s2 = (pa.array(spans_hash(h, start[open_], start[open_] + length - w + 1, base).view(np.int64)) for base in (_BASE, _BASE2))
                lo = lows[row[open_]] + inner[open_]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[open_])), pa.array(lo), pa.array(lo + length), s1, s2], names=["id", "lo", "hi", "s1", "s2"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            bucket = held.column("bucket").to_numpy()
            other = np.flatnonzero(bucket != bucket[-1])
            if len(other):
                yield from decided(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
        if held is not None:
            yield from decided(held)

    return run


def _removal_pass(batches):
    """Digest and text without the union of a text's spans."""
    for batch in batches:
        ids, texts, lists = batch.column("id"), batch.column("text"), batch.column("spans")
        cols: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            raw = texts[i].as_buffer() if texts[i].is_valid else b""
            raw = bytes(raw) if raw is not None else b""
            runs: list[list[int]] = []
            if lists[i].is_valid:
                part = lists[i].values
                lo, hi = part.field("lo").to_numpy(), np.minimum(part.field("hi").to_numpy(), len(raw))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                cut = np.ones(len(lo), dtype=bool)
                cut[1:] = lo[1:] > hi[:-1]
                begin = np.flatnonzero(cut)
                ends = hi[np.append(begin[1:] - 1, len(hi) - 1)] if len(hi) else hi
                runs = [[int(a), int(b)] for a, b in zip(lo[begin], ends, strict=True) if a < b]
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            for col, v in zip(cols, (len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, w: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Removes every byte covered by a string of `length` bytes that also starts earlier in the corpus
    (smaller key, or same key and earlier start); strings do not cross texts and are judged on the input.

    1. Parse: triggers of a rolling hash cut texts into phrases, so that equal strings are cut alike.
    2. Phrases whose trigger comes once in the corpus hold no repeated string and are dropped.
    3. Dictionary: of equal phrases (with the `length` - 1 bytes that follow), the first stays; all strings
       of the others are repeats.
    4. Dictionary phrases that share a trigger but differ: what they share around it bounds the suffixes
       that can repeat. The suffixes of the phrases of a trigger are sorted as bytes, to a depth of `length`, which is as
       deep as the question goes: a phrase reaches `length` - 1 bytes beyond its last start, so a string lies whole
       in each phrase that has it. With the parse, which says where a phrase stands first, that is corpus order to this
       depth: suffixes that agree are neighbours, and each but the first of such a run is a repeat.
    5. A trigger of many phrases is dealt to several arrays of some ENTRIES phrases; the heads of their
       runs are merged by the 128-bit digest of the string. No array holds more, whatever the corpus.

    Null and empty texts have no bytes. Rows are judged each by its own text: of rows that share a key, or
    have none, the one with the smaller digest of its text counts as earlier, and null keys come first. Only rows equal in
    key and text are one text: they get the same result, as a string is no repeat of itself at the same start.
    A text is parsed in one task, at some 60 bytes of memory a byte.
    """
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col(key).isNull() | (F.col("c") > 1)).limit(1).count():
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        own = docs.select(F.struct(F.col(key).alias("key"), F.sha2(body.cast("binary"), 256).alias("digest")).alias("_key"), body.alias("_text"))
        return _repeats_removed(own, length, w, "_key", "_text").select(F.col("_key.key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return _repeats_removed(docs, length, w, key, text)


def _repeats_removed(docs: DataFrame, length: int, w: int, key: str, text: str) -> DataFrame:
    """remove_repeats for keys that tell texts apart."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    triggers = slim.select("text").mapInArrow(_triggers_pass(length, w), "k long, n long")
    shared = stored(triggers.groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1").select("k"), "suffix-triggers")
    parse = slim.mapInArrow(_phrases_pass(length, w), f"k long, e long, id {kind}, lo long, n int, fresh boolean")
    # Key tables are the built sides of hash joins: the many phrases are not sorted.
    parse = stored(parse.join(shared.hint("shuffle_hash"), "k", "left_semi"), "suffix-parse")
    firsts = stored(parse.groupBy("k", "e").agg(F.min("id").alias("id0"), F.max(F.col("id").isNull()).alias("null0"), F.count(F.lit(1)).alias("c")), "suffix-dictionary")
    firsts = firsts.withColumn("id0", F.when(~F.col("null0"), F.col("id0"))).drop("null0")  # a null key comes first
    several = stored(firsts.groupBy("k").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1").select("k", F.ceil(F.col("entries") / ENTRIES).cast("int").alias("split")), "suffix-several")
    firsts = stored(firsts.join(several, "k", "left").filter("c > 1 or split is not null"), "suffix-firsts")
    marked = stored(parse.join(firsts.hint("shuffle_hash"), ["k", "e"]).withColumn("first", F.col("fresh") & F.col("id").eqNullSafe(F.col("id0"))).filter("not first or split is not null").select("id", "lo", "n", "first", "k", "split"), "suffix-marked")
    spans = marked.filter("not first").select("id", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    # Dictionary phrases with a trigger in common.
    parts = stored(marked.filter("first").groupBy("id").agg(F.collect_set(F.struct("lo", "n", "k", "split")).alias("parts")), "suffix-parts")
    own = parts.withColumnRenamed("id", "part_id")
    reaches = slim.join(own, slim["id"].eqNullSafe(own["part_id"])).drop("part_id").mapInArrow(_reaches_pass(length), f"id {kind}, lo long, k long, split int, reach binary")
    reaches = stored(reaches, "suffix-reaches")
    # What a phrase shares with another one around the trigger bounds the suffixes that can be repeats.
    contexts = reaches.mapInArrow(_contexts_pass(length, w), f"c long, id {kind}, lo long, left int, right int")
    common = stored(contexts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c"), "suffix-contexts")
    bounds = contexts.join(common.hint("shuffle_hash"), "c", "left_semi").groupBy("id", "lo").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    bounds = stored(bounds.withColumnRenamed("id", "bound_id").withColumnRenamed("lo", "bound_lo"), "suffix-bounds")
    reaches = stored(reaches.join(bounds, reaches["id"].eqNullSafe(bounds["bound_id"]) & (reaches["lo"] == bounds["bound_lo"])).drop("bound_id", "bound_lo"), "suffix-bounded")
    # Suffix arrays of the dictionary, by trigger: a string of `length` bytes lies whole in every phrase that has it, and equal strings have equal triggers.
    place = F.xxhash64("id", "lo")
    dealt = reaches.withColumn("place", place).withColumn("bucket", F.xxhash64("k", F.pmod("place", F.col("split")))).drop("k")
    sorted_ = stored(dealt.repartition("bucket").sortWithinPartitions("bucket", "id", "lo").mapInArrow(_suffix_arrays_pass(length, w), f"id {kind}, lo long, hi long, s1 long, s2 long"), "suffix-arrays")
    # Arrays of one trigger are merged by their heads: of equal ones all but the first are repeats.
    heads = sorted_.filter("s1 is not null")
    runs = heads.groupBy("s1", "s2").agg(F.min(F.struct("id", "lo")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    runs = stored(runs.select("s1", "s2", F.col("f.id").alias("id0"), F.col("f.lo").alias("lo0")), "suffix-heads")
    later = heads.join(runs.hint("shuffle_hash"), ["s1", "s2"]).filter(~(F.col("id").eqNullSafe(F.col("id0")) & (F.col("lo") == F.col("lo0"))))
    spans = spans.union(sorted_.filter("s1 is null").select("id", "lo", "hi")).union(later.select("id", "lo", "hi"))
    listed = stored(spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans").withColumnRenamed("id", "span_id")
    joined = slim.join(listed, slim["id"].eqNullSafe(listed["span_id"]), "left").drop("span_id")
    return joined.mapInArrow(_removal_pass, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", key)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w
), m AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f WHERE r > 1
), g AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m
), sp AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k
), t AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id
), gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM sp
  UNION ALL SELECT doc_id, max(b), max(n) FROM sp JOIN d USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kh FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kh, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
