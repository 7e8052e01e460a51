"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import blocks, hashed_words, mixed, most_frequent, released, stored

#: Tokens that many texts share go last in the global order. The order only decides how many
#: candidates there are, never which links are found, so this list may be bounded.
HOT_TOKENS = 1 << 20
HOT_IN_BLOCK, HOT_TOTAL, HOT_LISTED, BLOCK = 3, 16, 3, 4 << 20
#: Rows of a block of a tile, and 64-bit words of bitmaps that are compared at once.
TILE_ROWS, TILE_WORDS = 1024, 1 << 21
#: 64-bit words of the smallest parity bitmap; a bitmap has at least as many bits as its set has hashes.
SIGNATURE = 4

_MULT = mixed(np.arange(101, 133, dtype=np.uint64))


def _doc_order(docs: np.ndarray, rows: int, *keys: tuple[np.ndarray, int]) -> np.ndarray:
    """Order by document, then by the leading bits of the keys (values, bits of each; the last fills what is left), as one sort of whole numbers."""
    left = 64 - int(rows).bit_length()
    packed = docs.astype(np.uint64) << np.uint64(left)
    for value, bits in keys[:-1]:
        left -= bits
        packed |= value.astype(np.uint64) << np.uint64(left)
    return np.argsort(packed | (keys[-1][0] >> np.uint64(64 - left)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """(document index, hash) of the distinct n-word shingles of a block's texts, sorted by document and leading bits of the hash; a text of fewer words has one for all of them."""
    doc, h, _, _ = hashed_words(data, offsets)
    rows = len(offsets) - 1
    last = len(doc) - n + 1
    ok = np.flatnonzero(doc[: max(last, 0)] == doc[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
    value = np.full(len(ok), n, dtype=np.uint64)
    for j in range(n):
        value += h[ok + j] * _MULT[j]
    docs, values = [doc[ok]], [mixed(value)]
    first = np.searchsorted(doc, np.arange(rows))
    count = np.bincount(doc, minlength=rows) if len(doc) else np.zeros(rows, np.int64)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            value = np.full(len(short), k, dtype=np.uint64)
            for j in range(k):
                value += h[first[short] + j] * _MULT[j]
            docs.append(short)
            values.append(mixed(value))
    docs, values = np.concatenate(docs), np.concatenate(values)
    order = _doc_order(docs, rows, (values, 64))
    docs, values = docs[order], values[order]
    if len(docs):
        new = np.ones(len(docs), dtype=bool)
        new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
        docs, values = docs[new], values[new]
    return docs, values


def _sums(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each document, modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    at = np.searchsorted(docs, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def _sets_pass(n: int):
    """Rows of kind 0: id, set size, digest of 128 bits; of kind 1: a token that several texts of about BLOCK bytes hold, and in how many."""

    def counted(held, kind):
        token, times = np.unique(np.concatenate(held), return_counts=True)
        many = times >= HOT_IN_BLOCK
        k = int(many.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, kind), pa.array(times[many].astype(np.int64)), pa.array(token[many].view(np.int64)), pa.array(np.zeros(k, np.int64))], names=["kind", "id", "n", "d1", "d2"])

    def run(batches):
        held, size_held, kind = [], 0, None
        for batch in batches:
            ids, kind = batch.column(0), batch.column(0).type
            for first, offsets, data in blocks(batch.column(1)):
                rows = len(offsets) - 1
                docs, values = shingle_sets(data, offsets, n)
                size = np.bincount(docs, minlength=rows).astype(np.int64)
                d1, d2 = _sums(mixed(values ^ _MULT[20]), docs, rows), _sums(mixed(values + _MULT[21]), docs, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), ids.slice(first, rows), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["kind", "id", "n", "d1", "d2"])
                held.append(values)
                size_held += len(data)
                if size_held >= BLOCK:
                    yield counted(held, kind)
                    held, size_held = [], 0
        if held:
            yield counted(held, kind)

    return run


def _buckets_of(known: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """How far sorted hashes are shifted to their bucket by leading bits, and where each bucket begins; made once for all blocks of a task."""
    shift = np.uint64(64 - max(1, int(len(known)).bit_length()))
    return shift, np.searchsorted((known >> shift).astype(np.int64), np.arange((1 << (64 - int(shift))) + 1)).astype(np.int32)


def _classes_of(values: np.ndarray, known: np.ndarray, classes: np.ndarray, shift: np.uint64, start: np.ndarray) -> np.ndarray:
    """Class of each token, 0 for tokens that are not listed: its bucket among the listed ones, then steps within the bucket."""
    out = np.zeros(len(values), dtype=np.uint8)
    bucket = (values >> shift).astype(np.int64)
    at, end = start[bucket], start[bucket + 1]
    left = np.flatnonzero(at < end)
    while len(left):
        same = known[at[left]] == values[left]
        out[left[same]] = classes[at[left[same]]]
        left = left[~same]
        at[left] += 1
        left = left[at[left] < end[left]]
    return out


def _prefix_pass(n: int, percent: int, hot):
    """(token, id, n, pos): the n - ceil(percent n / 100) + 1 tokens of a set that come first in the global order: by how many texts are known to hold them (classes of hot tokens, 0 for others), then by hash. Sets that are similar enough share one of them."""

    def run(batches):
        known, classes = hot.value
        buckets = _buckets_of(known) if len(known) else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, offsets, data in blocks(texts):
                rows = len(offsets) - 1
                docs, values = shingle_sets(data, offsets, n)
                if not len(docs):
                    continue
                size = np.bincount(docs, minlength=rows).astype(np.int64)
                if len(known):
                    order = _doc_order(docs, rows, (_classes_of(values, known, classes, *buckets), 6), (values, 64))
                    docs, values = docs[order], values[order]
                pos = np.arange(len(docs)) - np.searchsorted(docs, docs)
                take = pos < (size - (percent * size + 99) // 100 + 1)[docs]
                docs, values, pos = docs[take], values[take], pos[take]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), ids.slice(first, rows).take(pa.array(docs)), pa.array(size[docs]), pa.array(pos.astype(np.int32))], names=["token", "id", "n", "pos"])

    return run


def _signature_pass(n: int):
    """(id, n, signature): bitmap of parities: bit i tells whether an odd number of a set's hashes falls on i. Its length is a power of two, so a longer one folds onto a shorter."""

    def run(batches):
        for batch in batches:
            for first, offsets, data in blocks(batch.column(1)):
                rows = len(offsets) - 1
                docs, values = shingle_sets(data, offsets, n)
                size = np.bincount(docs, minlength=rows).astype(np.int64)
                width = np.maximum(SIGNATURE, 2 ** np.ceil(np.log2(np.maximum(size, 1) / 64)).astype(np.int64).clip(0))
                base = np.concatenate([[0], np.cumsum(width)])
                place = 64 * base[docs] + (values & (64 * width[docs] - 1).astype(np.uint64)).astype(np.int64)
                parity = (np.bincount(place, minlength=64 * int(base[-1])) & 1).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(np.packbits(parity).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(size), lists], names=["id", "n", "signature"])

    return run


def _arrays_pass(n: int):
    """(id, values): sorted shingle hashes."""

    def run(batches):
        for batch in batches:
            for first, offsets, data in blocks(batch.column(1)):
                rows = len(offsets) - 1
                docs, values = shingle_sets(data, offsets, n)
                at = np.searchsorted(docs, np.arange(rows + 1)).astype(np.int32)
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    values[lo:hi].sort()  # the packed order leaves the last bits open
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))], names=["id", "values"])

    return run


def _verify(percent: int):
    """Keeps the pairs whose exact overlap is large enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("va"), batch.column("vb")
            keep = []
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(zero_copy_only=False).view(np.uint64), b[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _fold(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def _tile_pass(percent: int):
    """(a, b): the pairs of a tile that length, place and bitmaps leave possible, compared within the tile so that no other pair is ever made.

    Rows come sorted by (tile, i, j, side), as _blocks deals them. A block (i, i) compares all its rows with each other, a block (i, j) those of side i
    with those of side j; members of one component are not compared. A block has a bounded number of rows.
    """

    def pairs_of(batch):
        tile, i, j, side = (batch.column(c).to_numpy() for c in ("tile", "i", "j", "side"))
        n, pos, part = batch.column("n").to_numpy(), batch.column("pos").to_numpy().astype(np.int64), batch.column("part").dictionary_encode().indices.to_numpy()
        ids, lists = batch.column("id"), batch.column("signature")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        width = lists.value_lengths().to_numpy().astype(np.int64)
        at = np.cumsum(width) - width
        new = np.ones(len(tile) + 1, dtype=bool)
        new[1:-1] = (tile[1:] != tile[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new[:-1]) - 1
        end = start[1:][group]
        low = np.add.reduceat((side == i).astype(np.int64), start[:-1])[group]  # rows of side i come first
        row = np.arange(len(tile))
        begin = np.where(i == j, row + 1, np.where(side == i, start[:-1][group] + low, end))
        count = end - begin
        work = np.cumsum(count * width)
        first = 0
        while first < len(row):
            last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + TILE_WORDS)))
            c = count[first:last]
            a = np.repeat(row[first:last], c)
            b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + begin[a]
            first = last
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            both = n[a] + n[b]
            ok = (part[a] != part[b]) & (100 * small >= percent * large) & ((100 + percent) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= percent * both)
            a, b = a[ok], b[ok]
            keep = np.zeros(len(a), dtype=bool)
            for wa, wb in {*zip(width[a].tolist(), width[b].tolist(), strict=True)}:
                k = np.flatnonzero((width[a] == wa) & (width[b] == wb))
                x, y = flat[at[a[k]][:, None] + np.arange(wa)], flat[at[b[k]][:, None] + np.arange(wb)]
                x, y = (_fold(x) if wa > wb else x), (_fold(y) if wb > wa else y)
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                total = n[a[k]] + n[b[k]]
                # Every differing bit needs an element of one set alone: 2 * overlap <= na + nb - apart.
                keep[k] = (100 + percent) * (total - apart) >= 2 * percent * total
            if keep.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[keep])), ids.take(pa.array(b[keep]))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            key = [held.column(c).to_numpy() for c in ("tile", "i", "j")]
            other = (key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1])
            done = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if done:
                yield from pairs_of(held.slice(0, done))
                held = held.slice(done)
        if held is not None:
            yield from pairs_of(held)

    return run


def _possible(na: Column, nb: Column, percent: int) -> Column:
    """Length bound: the smaller set is large enough to overlap as asked."""
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _reachable(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Positional bound: what comes from a common token on is enough for the overlap. Where a pair's first common token fails, later ones fail too."""
    return (100 + percent) * F.least(na - pa_, nb - pb) >= percent * (na + nb)


def _hot(tokens: DataFrame):
    """Sorted hot tokens and their classes (from 1) out of (token, times): at most HOT_TOKENS of 9 bytes."""
    found = most_frequent(tokens, "times", HOT_TOKENS).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return tokens.sparkSession.sparkContext.broadcast((token[order], (1 + np.log2(found["times"].to_numpy(np.float64)[order])).astype(np.uint8)))


def _likely(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps leave possible."""
    x, y = (signatures.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}")) for k in "ab")
    # Sizes within the length bound differ by less than a factor of two, so one fold makes the bitmaps equal in length.
    half = lambda c: F.floor(F.size(c) / 2).cast("int")
    folded = lambda c, d: F.when(F.size(c) > F.size(d), F.zip_with(F.slice(c, 1, half(c)), F.slice(c, half(c) + 1, half(c)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(folded("sa", "sb"), folded("sb", "sa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    # Every differing bit needs an element of one set alone: 2 * overlap <= na + nb - apart.
    bound = (100 + percent) * (F.col("na") + F.col("nb") - apart) >= 2 * percent * (F.col("na") + F.col("nb"))
    return pairs.join(x, "a").join(y, "b").filter(_possible(F.col("na"), F.col("nb"), percent) & bound).select("a", "b")


def _links(likely: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs of a stored table (a, b) that are links, by the intersection of their sorted arrays."""
    ids = stored(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    kind = texts.schema["id"].dataType.simpleString()
    arrays = stored(texts.join(ids, "id", "left_semi").mapInArrow(_arrays_pass(shingle), f"id {kind}, values array<long>"), "jaccard-arrays")
    u, v = (arrays.select(F.col("id").alias(k), F.col("values").alias(f"v{k}")) for k in "ab")
    return stored(likely.join(u, "a").join(v, "b").mapInArrow(_verify(percent), likely.schema), "jaccard-links")


def _by_rows(docs: DataFrame, shingle: int, percent: int, key: str, text: str) -> DataFrame:
    """jaccard_classes for keys that are null or repeat: rows get a number of their own, and a component the smallest key among its rows."""
    rows = stored(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
    classes = stored(jaccard_classes(rows, shingle, percent, "_row", "_text"), "jaccard-row-classes")
    named = rows.select("_key", "_row").join(classes, "_row")
    least = named.groupBy("component_id").agg(F.min("_key").alias("_least"))
    return named.join(least, "component_id").select(F.col("_key").alias(key), "n_shingles", F.col("_least").alias("component_id"))


def _blocks(named: DataFrame, rows: int) -> DataFrame:
    """(tile, i, j, side, id, pos, part): the rows of tiles with several components, dealt to blocks of pairs that may still be links.

    A tile's largest component is never compared with itself: rows of other components, the outsiders, meet each other and the
    rows of the largest. Sides have about `rows` rows; those of the outsiders come first. An outsider is copied once for each side, a row of the largest component
    once for each side of outsiders only, so a few outsiders among any number of near copies leave the rows as many as they were.
    """
    sizes = named.groupBy("tile", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("tile").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("c")).filter("m.c < c")
    sides = lambda c: F.ceil(c / rows).cast("int")
    several = stored(sizes.select("tile", F.col("m.part").alias("largest"), sides(F.col("c") - F.col("m.c")).alias("out"), sides(F.col("m.c")).alias("own")), "jaccard-mixed")
    among = F.col("part") != F.col("largest")
    place = F.xxhash64("id")
    side = F.when(among, F.pmod(place, F.col("out"))).otherwise(F.col("out") + F.pmod(place, F.col("own"))).cast("int")
    others = F.sequence(F.lit(0), F.when(among, F.col("out") + F.col("own")).otherwise(F.col("out")) - 1)
    dealt = named.join(several, "tile").withColumn("side", side).withColumn("other", F.explode(others))
    return dealt.select("tile", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "pos", "part")


def jaccard_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key, n_shingles, component_id (smallest key reachable over links, itself included).

    Two texts link where 100 * intersection >= percent * union of their sets of shingles (distinct
    runs of `shingle` words, A-Z in lower case; fewer words: all of them as one).

    - Equal sets are one class from the start; only the least key of a class goes on.
    - Prefix filter: each set lists its first tokens in a global order that puts tokens shared by many
      texts last; sets that link share a listed token. Tokens listed once are dropped before the join.
    - Tiles: a token and a band of set sizes. In a tile every member is compared with one leader, which
      joins groups of near copies without listing their pairs. Then members of different components
      are compared inside the tile, by length, place of the common token and bit counts of parity bitmaps (an upper
      bound of the overlap); only pairs that all of these leave possible come out. The largest component of a tile is not
      compared with itself, and a large tile is dealt to blocks, each compared by a task of its own.
    - What is left is decided exactly by intersecting sorted arrays.

    Keys may be of any type that has an order. Rows are judged one by one: rows whose key is null or
    repeats count each by its own text, and their component has the smallest key among its rows (null if it has none).
    Null or empty texts have no shingles and link with nothing. An empty table gives an empty result.
    A text is tokenised in one task, at some 60 bytes of memory a byte.
    """
    spark = docs.sparkSession
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col(key).isNull() | (F.col("c") > 1)).limit(1).count():
        return _by_rows(docs, shingle, percent, key, text)
    slim = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    first = stored(slim.mapInArrow(_sets_pass(shingle), f"kind int, id {kind}, n long, d1 long, d2 long"), "jaccard-sets")
    sets = first.filter("kind = 0").drop("kind")
    heavy = stored(first.filter("kind = 1").groupBy(F.col("d1").alias("token")).agg(F.sum("n").alias("times")).filter(F.col("times") >= HOT_TOTAL), "jaccard-heavy")
    reps = stored(sets.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "jaccard-reps")
    listing = lambda hot: slim.mapInArrow(_prefix_pass(shingle, percent, hot), f"token long, id {kind}, n long, pos int")
    counted = lambda tokens: tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    # What a first order lists too often is put further back in the second, by its exact count.
    often = stored(counted(listing(_hot(heavy))).filter(F.col("times") >= HOT_LISTED), "jaccard-often")
    hot = stored(heavy.union(often).groupBy("token").agg(F.max("times").alias("times")), "jaccard-hot")
    tokens = stored(listing(_hot(hot)), "jaccard-tokens")
    shared = stored(counted(tokens).filter("times > 1").select("token"), "jaccard-shared")
    listed = stored(tokens.join(shared.hint("shuffle_hash"), "token", "left_semi"), "jaccard-listed")  # the many tokens are not sorted
    released(heavy, often, hot, tokens, shared)
    # Only one of equal sets, and tokens that still have two texts.
    only = reps.select(F.col("rep").alias("id"), "copies")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    member = listed.join(only, "id").withColumn("band", F.explode(F.array(band, band + 1)))
    member = stored(member.withColumn("tile", F.xxhash64("token", "band")).select("tile", "id", "n", "pos", "copies"), "jaccard-members")
    released(listed)
    lead = member.groupBy("tile").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(-F.col("copies"), "id", "n", "pos")).alias("m")).filter("c > 1")
    lead = stored(lead.select("tile", F.col("m.id").alias("lead"), F.col("m.n").alias("lead_n"), F.col("m.pos").alias("lead_pos")), "jaccard-leaders")
    members, member = member, stored(member.join(lead.select("tile"), "tile", "left_semi"), "jaccard-tiles")
    released(members)
    starred = member.join(lead, "tile").filter((F.col("id") != F.col("lead")) & _possible(F.col("n"), F.col("lead_n"), percent) & _reachable(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), percent))
    starred = starred.groupBy(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).agg(F.count(F.lit(1)).alias("c")).select("a", "b")
    wanted = stored(member.select("id").distinct(), "jaccard-wanted")
    texts = stored(slim.join(wanted, "id", "left_semi"), "jaccard-texts")
    signatures = stored(texts.mapInArrow(_signature_pass(shingle), f"id {kind}, n long, signature array<long>"), "jaccard-signatures")
    links = _links(stored(_likely(starred, signatures, percent), "jaccard-likely"), texts, shingle, percent)
    parts = connected_components(links)
    named = stored(member.join(parts, "id", "left").select("tile", "id", "n", "pos", F.coalesce("component", "id").alias("part")), "jaccard-parts")
    released(member, lead)
    cross = _blocks(named, TILE_ROWS).join(signatures, "id")
    cross = cross.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "side").mapInArrow(_tile_pass(percent), f"a {kind}, b {kind}")
    cross = stored(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-cross")
    released(named, signatures)
    links = links.union(_links(cross, texts, shingle, percent))
    parts = connected_components(links)
    named = reps.join(parts, reps["rep"] == parts["id"], "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(named, ["n", "d1", "d2"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs, shingle=4, percent=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
