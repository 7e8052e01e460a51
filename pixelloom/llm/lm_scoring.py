"""Language-model scoring: n-gram tries in Elias-Fano levels with quantised smoothed probabilities."""

from __future__ import annotations

import shutil
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, crc_of, hashed_words, mixed, most_frequent, stored

END, BEGIN = (int(x) for x in mixed(np.array([77, 78], dtype=np.uint64)))
ADD = 0.1
#: Words whose counts are at hand everywhere: at most so many of the most frequent ones. Counts of other contexts come by a join.
FREQUENT = 1 << 20
#: Smoothing mass of a context: this share of its count, a constant for BEGIN and for words that no training text has.
SHARE, CONSTANT = 1.0, 8.0
SHARD_TOKENS, CHUNK = 2_000_000, 4 << 20
LOW_BITS, LOW_MASK = np.uint64(48), np.uint64((1 << 48) - 1)
_PAIR = np.uint64(int(mixed(np.array([79], dtype=np.uint64))[0]) | 1)


class EliasFano:
    """A sorted sequence of numbers in a file: high parts in unary, low parts of a whole number of bytes, packed.

    The file is memory-mapped, and both parts are read where they lie. Beside it stands only a count of the zeros before each 64 bits of the
    unary part, from which the place of any zero follows by halving the 64 bits that hold it.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, low_bytes: int, path: str):
        self.n, self.low_bytes = len(high), low_bytes
        self.highs = int(high[-1]) + 1 if self.n else 1
        bits = np.ones(-(-(self.n + self.highs) // 64) * 64, dtype=bool)  # what is beyond the end is no zero
        bits[: self.n + self.highs] = False
        bits[high.astype(np.int64) + np.arange(self.n)] = True
        low = np.ascontiguousarray(low.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :low_bytes]
        with open(path, "wb") as f:
            f.write(np.packbits(bits, bitorder="little").tobytes())
            f.write(np.ascontiguousarray(low).tobytes())
        cut = len(bits) // 8
        mapped = np.memmap(path, np.uint8, "r")
        self.unary = mapped[:cut].view("<u8")
        zeros = 64 - np.bitwise_count(self.unary).astype(np.int64)
        self.before = np.cumsum(zeros) - zeros
        self.low = mapped[cut:].reshape(self.n, low_bytes)

    def zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the unary part, from 0."""
        at = np.searchsorted(self.before, k, side="right") - 1
        left, bits, place = k - self.before[at], ~self.unary[at], at * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low)
            above = left >= n
            left = left - np.where(above, n, 0)
            bits = np.where(above, bits >> np.uint64(width), low)
            place = place + width * above
        return place

    def low_at(self, rank: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rank), 8), dtype=np.uint8)
        out[:, : self.low_bytes] = self.low[rank]
        return out.view("<u8").ravel()

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks [from, to) of the numbers with this high part."""
        high = high.astype(np.int64)
        inside = (high >= 0) & (high < self.highs)
        h = np.where(inside, high, 0)
        to = self.zero(h) - h
        start = np.where(h > 0, self.zero(np.maximum(h - 1, 0)) - h + 1, 0)
        return np.where(inside, start, 0), np.where(inside, to, 0)

    def find(self, high: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Rank of each number given by its high and low part, or -1."""
        return self.within(*self.bucket(high), want) if len(high) else np.zeros(0, np.int64)

    def within(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Rank of each low part among the ranks [lo, hi) of its bucket, or -1: successor search by halving."""
        found, lo = np.full(len(want), -1, np.int64), lo.copy()
        open_ = np.flatnonzero(lo < hi)
        end, hi = hi, hi.copy()
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_at(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < end)
        there = there[self.low_at(lo[there]) == want[there]]
        found[there] = lo[there]
        return found


class Trie:
    """Level 1: words, as leading 16 bits and 6 bytes, with counts. Level 2: the contexts seen before each word, found relative to
    it: the high part of an entry is the word's rank, so unary high parts are the monotone pointers from
    words to their contexts; the low part is the context, 6 bytes of its hash. Each entry holds the logarithm of its smoothed mass in 8 bits.
    All levels are memory-mapped files of `folder`; kept beside them is a number for each 64 bits of their unary parts."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, totals, prior, mass, folder: str):
        """Sorted pairs with their counts; totals(words, sums), prior(counts), mass(contexts) give word counts, P(word) and smoothing mass."""
        new = np.ones(len(word), dtype=bool)
        new[1:] = word[1:] != word[:-1]
        first = np.flatnonzero(new)
        words = word[first]
        counts = totals(words, np.add.reduceat(count, first) if len(first) else count)
        rank = np.cumsum(new) - 1
        value = np.log10(count + mass(context) * prior(counts)[rank])
        self.low, high = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        self.step = max((high - self.low) / 255, 1e-9)
        self.level1 = EliasFano(words >> LOW_BITS, words & LOW_MASK, 6, f"{folder}/words")
        self.level2 = EliasFano(rank, context, 6, f"{folder}/contexts")
        self.count, self.code = (_mapped(f"{folder}/{name}", x) for name, x in (("counts", counts), ("codes", np.rint((value - self.low) / self.step).astype(np.uint8))))

    def word_rank(self, words: np.ndarray) -> np.ndarray:
        return self.level1.find(words >> LOW_BITS, words & LOW_MASK)

    def log_mass(self, rank: np.ndarray, n_context: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Quantised logarithm for the contexts below words: each word's rank, how many of the contexts are asked below it, and these in order; NaN where there is none."""
        lo, hi = (np.repeat(x, n_context) for x in self.level2.bucket(rank))
        place = self.level2.within(lo, hi, context)
        return np.where(place >= 0, self.low + self.step * self.code[np.maximum(place, 0)], np.nan) if len(self.code) else np.full(len(context), np.nan)


def _mapped(path: str, x: np.ndarray) -> np.ndarray:
    x.tofile(path)
    return np.memmap(path, x.dtype, "r") if len(x) else x


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    """(document, token, token before) in order; every text ends with END and begins after BEGIN."""
    doc, h, _, _ = hashed_words(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(doc, minlength=rows) + 1
    token = np.full(int(count.sum()), END, dtype=np.uint64)
    token[np.arange(len(doc)) + doc] = h
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(count) - count] = BEGIN
    return np.repeat(np.arange(rows), count), token, before


def _counts_pass(batches):
    """(word, n) of the training texts; and, without a word, the number of tokens of the other texts."""
    for batch in batches:
        held, found, other = batch.column(1).to_numpy(zero_copy_only=False), [], 0
        for first, offsets, data in blocks(batch.column(0)):
            doc, word, _ = tokens_of(data, offsets)
            out = held[first : first + len(offsets) - 1][doc]
            other += int(out.sum())
            found.append(word[~out])
        if found:
            word, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([other], pa.int64())], names=["word", "n"])


def _six(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**48 as 6 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _of_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds.split())), 8 * len(kinds.split()), []
    for n, kind in zip(sizes, kinds.split(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


#: word, contexts of each word, context (6 bytes), training count, texts of each pair, text, times in it
_KINDS = "u8 u4 u1 u4 u4 u2 u4"
#: 6 of the 8 bytes of a word's hash tell contexts apart.
CONTEXT = np.uint64(16)


def _shard_of(word: np.ndarray, context: np.ndarray, hot: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each pair: by its word, or by the whole pair if the word is hot."""
    shard = ((word >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, word), len(hot) - 1)] == word
        shard = np.where(is_hot, (mixed(word + context * _PAIR) % np.uint64(n_shards)).astype(np.int64), shard)
    return shard


def _wanted_pass(n_shards: int, hot, shared):
    """(word, shard): the contexts of a chunk whose counts are not at hand, and the shards that hold pairs of them."""

    def run(batches):
        frequent = shared.value[2]
        for batch in batches:
            for _, offsets, data in _chunks(batch.column("text")):
                _, word, before = tokens_of(data, offsets)
                rare = before != BEGIN
                if len(frequent):
                    rare &= frequent[np.minimum(np.searchsorted(frequent, before), len(frequent) - 1)] != before
                word, before = word[rare], before[rare]
                shard = _shard_of(word, before, hot.value, n_shards)
                order = np.lexsort((shard, before))
                before, shard = before[order], shard[order]
                new = np.ones(len(before), dtype=bool)
                new[1:] = (before[1:] != before[:-1]) | (shard[1:] != shard[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(before[new].view(np.int64)), pa.array(shard[new].astype(np.int32))], names=["word", "shard"])

    return run


def _pairs_pass(n_shards: int, hot):
    """Deals the (word, context) pairs of a chunk of texts to shards: by word, but the pairs of a hot word one by one."""

    def run(batches):
        known, part, chunk = hot.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held = batch.column("id"), batch.column("held_out").to_numpy(zero_copy_only=False)
            for first, offsets, data in _chunks(batch.column("text")):
                rows = len(offsets) - 1
                doc, word, before = tokens_of(data, offsets)
                order = np.lexsort((before, word))
                doc, word, before = doc[order], word[order], before[order]
                pair = np.ones(len(word), dtype=bool)
                pair[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
                entry = pair.copy()
                entry[1:] |= doc[1:] != doc[:-1]
                p, e = np.flatnonzero(pair), np.flatnonzero(entry)
                times = np.diff(np.append(e, len(word))).astype(np.uint32)
                entry_pair = (np.cumsum(pair) - 1)[e]
                train = (~held[first : first + rows]).astype(np.uint32)
                trained = np.add.reduceat(train[doc], p)
                pw, pc = word[p], before[p]
                shard = _shard_of(pw, pc, known, n_shards)
                held_by = np.bincount(entry_pair, minlength=len(p)).astype(np.uint32)
                e_first = np.cumsum(held_by, dtype=np.int64) - held_by
                by_shard = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[by_shard], np.arange(n_shards + 1))
                blobs, held_shards = [], np.flatnonzero(np.diff(cuts))  # only shards that get something, every text has an end
                for s in held_shards:
                    at = by_shard[cuts[s] : cuts[s + 1]]
                    w, n_context = np.unique(pw[at], return_counts=True)
                    n_entry = held_by[at]
                    total = int(n_entry.sum())
                    pick = np.repeat(e_first[at] - (np.cumsum(n_entry, dtype=np.int64) - n_entry), n_entry) + np.arange(total)
                    blobs.append(_packed(w, n_context.astype(np.uint32), _six(pc[at] >> CONTEXT), trained[at].astype(np.uint32), n_entry, doc[e][pick].astype(np.uint16), times[pick]))
                tokens = np.bincount(doc, minlength=rows)
                name = (part << 32) | chunk
                chunk += 1
                own = ids.slice(first, rows)
                lists = [pa.ListArray.from_arrays(pa.array(np.array([0] + [rows] * len(blobs), np.int32)), x) for x in (own, pa.array(held[first : first + rows]), pa.array(tokens.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), name)), pa.array(held_shards.astype(np.int32)), pa.array(np.full(len(blobs), rows, np.int32)), pa.array(blobs, pa.binary()), *lists], names=["chunk", "shard", "rows", "blob", "ids", "held", "tokens"])

    return run


def _chunks(column):
    """Blocks of at most 65,535 texts, so that a text's place fits 16 bits."""
    for first, offsets, data in blocks(column, CHUNK):
        for a in range(0, len(offsets) - 1, 65_535):
            o = offsets[a : a + 65_536]
            yield first + a, o - o[0], data[o[0] : o[-1]]


def _present(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a pair, in order, and the place of each entry's text among them: by marks where most texts have one, else by sorting."""
    last = int(doc.max(initial=0)) + 1
    if 8 * len(doc) < last:
        return np.unique(doc, return_inverse=True)
    seen = np.zeros(last, dtype=bool)
    seen[doc] = True
    return np.flatnonzero(seen).astype(doc.dtype), (np.cumsum(seen) - 1)[doc]


def _shard_pass(shared):
    """Builds a shard's trie from the pairs of all chunks and answers the same pairs: sums for each text of a chunk.

    The second table has the training counts of the shard's contexts that are not among the frequent words.
    """

    def run(table: pa.Table, rare: pa.Table) -> pa.Table:
        n_all, v_all, frequent, frequent_n = shared.value
        frequent_contexts = frequent >> CONTEXT
        floor = ADD / (n_all + ADD * (v_all + 1))
        prior = lambda c: c / (n_all + ADD * (v_all + 1)) + floor

        other = rare.column("word").to_numpy().view(np.uint64) >> CONTEXT
        order = np.argsort(other)
        other, other_n = other[order], rare.column("n").to_numpy()[order].astype(np.float64)

        def looked_up(words, keys, values):
            at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            return (keys[at] == words, values[at]) if len(keys) else (np.zeros(len(words), bool), np.zeros(len(words)))

        def known(words):
            return looked_up(words, frequent, frequent_n)

        def mass_of(words, n):
            return np.where((n > 0) & (words != END), SHARE * n, CONSTANT)  # END stands for BEGIN, which comes as often

        def mass(contexts):
            there, n = looked_up(contexts, frequent_contexts, frequent_n)
            also, m = looked_up(contexts, other, other_n)
            return mass_of(contexts, np.where(there, n, np.where(also, m, 0)))

        def totals(words, sums):
            there, n = known(words)
            return np.where(there, n, sums).astype(np.int64)

        chunks = [_unpacked(b.as_py(), _KINDS) for b in table.column("blob")]
        for c in chunks:
            c[2] = _of_six(c[2])
        word = np.concatenate([np.repeat(c[0], c[1]) for c in chunks])
        context = np.concatenate([c[2] for c in chunks])
        count = np.concatenate([c[3] for c in chunks])
        seen = count > 0
        w, b, c = word[seen], context[seen], count[seen].astype(np.int64)
        order = np.lexsort((b, w))
        w, b, c = w[order], b[order], c[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        folder = tempfile.mkdtemp(prefix="trie-")  # the task's own scratch files, gone when it ends
        try:
            trie = Trie(w[first], b[first], np.add.reduceat(c, first) if len(first) else c, totals, prior, mass, folder)
            del word, context, count, seen, order, w, b, c, new, first
            return answered(table, chunks, trie, known, mass, mass_of, prior)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def answered(table, chunks, trie, known, mass, mass_of, prior) -> pa.Table:
        sums = []
        for cw, n_context, cb, _, n_entry, doc, times in chunks:
            rank = trie.word_rank(cw)
            n_word = np.where(rank >= 0, trie.count[np.maximum(rank, 0)], 0) if len(trie.count) else np.zeros(len(cw), np.int64)
            there, n = known(cw)  # a hot word's pairs are in many shards, its count is the same in all
            n_word = np.where(there, n, n_word).astype(np.int64)
            of = np.repeat(np.arange(len(cw)), n_context)
            top = trie.log_mass(rank, n_context, cb)
            missing = np.isnan(top)
            top[missing] = np.log10(mass(cb[missing]) * prior(n_word[of[missing]]))
            value = top - np.log10(n_word + mass_of(cw, n_word))[of]
            e = np.repeat(np.arange(len(cb)), n_entry)
            ew = of[e]
            texts, at = _present(doc)
            sums.append(_packed(texts, np.bincount(at, times * np.log10(n_word + ADD)[ew]), np.bincount(at, times * (n_word > 0)[ew]).astype(np.uint32), np.bincount(at, times * value[e])))
        return pa.table({"chunk": table.column("chunk"), "sums": pa.array(sums, pa.binary()), "rows": table.column("rows"), "ids": table.column("ids"), "held": table.column("held"), "tokens": table.column("tokens")})

    return run


def _sum_pass(norm: float):
    """Adds up a chunk's sums over the shards."""

    def run(table: pa.Table) -> pa.Table:
        with_ids = max(range(table.num_rows), key=lambda i: len(table.column("ids")[i].values or []))
        base, hits, model = np.zeros((3, table.column("rows")[0].as_py()))
        for blob in table.column("sums"):
            texts, *part = _unpacked(blob.as_py(), "u2 f8 u4 f8")
            for total, own in zip((base, hits, model), part, strict=True):
                total[texts] += own
        tokens = table.column("tokens")[with_ids].values
        return pa.table({"id": table.column("ids")[with_ids].values, "held_out": table.column("held")[with_ids].values, "n_tokens": tokens, "n_known": pa.array(hits.astype(np.int64)), "base_score": pa.array(base - tokens.to_numpy() * norm), "score": pa.array(model)})

    return run


def lm_scores(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are words (A-Z in lower case) and one end for each text; the model learns from rows that are
    not held out. base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens. score adds
    log10 of P(w | u) = (c(u, w) + m(u) P(w)) / (c(u) + m(u)), which sums to one for every context u:
    P(w) is the base, m(u) the smoothing mass: c(u), whatever the size of the input, and 8 for the
    begin of a text and for words that no training text has.

    1. Words are counted over the training rows: N, V, and the counts of the most frequent words. Each
       shard gets the counts of its other contexts by a join with the stored word counts.
    2. Chunks of texts send their distinct pairs (w, u), with training counts and the texts that hold them,
       to shards, by w; pairs of words that would overfill a shard are dealt one by one.
    3. A shard merges the counts into a trie of Elias-Fano levels and looks its pairs up: first w, then
       u among the contexts of w. What depends on u alone is added where u itself is the word.
    4. The sums of each text are added up over the shards.

    The shards follow the number of tokens, so a shard's memory does not grow. Null and empty texts are
    one end token; repeated rows are scored one by one; an empty table gives an empty result; with no
    training rows N and V are 0 and both scores use the add-0.1 floor.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    counted = slim.select("text", "held_out").mapInArrow(_counts_pass, "word long, n long")
    counts = stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    words = counts.filter("word is not null")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.count("word").alias("v")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    n_shards = max(6, -(-int(total["all"]) // SHARD_TOKENS))  # of all tokens: held-out pairs are dealt too
    top = most_frequent(words, "n", FREQUENT).toArrow()  # at most 16 MB
    limit = max(int(total["all"]) / (8 * n_shards), 1)
    frequent, frequent_n = (top[c].to_numpy() for c in ("word", "n"))
    order = np.argsort(frequent.view(np.uint64))
    frequent, frequent_n = frequent.view(np.uint64)[order], frequent_n[order]
    # Fewer than 8 * n_shards words can have so many tokens, so there are at most 64 bytes of them for each shard.
    heavy = words.filter(F.col("n") > limit).select("word").toArrow()["word"].to_numpy().view(np.uint64)
    hot = spark.sparkContext.broadcast(np.sort(heavy))
    shared = spark.sparkContext.broadcast((n_all, v_all, frequent, frequent_n.astype(np.float64)))
    lists = f"ids array<{kind}>, held array<boolean>, tokens array<long>"
    dealt = slim.mapInArrow(_pairs_pass(n_shards, hot), f"chunk long, shard int, rows int, blob binary, {lists}")
    wanted = slim.select("text").mapInArrow(_wanted_pass(n_shards, hot, shared), "word long, shard int").distinct()
    rare = wanted.join(words.hint("shuffle_hash"), "word").select("shard", "word", "n")
    sums = dealt.groupBy("shard").cogroup(rare.groupBy("shard")).applyInArrow(_shard_pass(shared), f"chunk long, sums binary, rows int, {lists}")
    norm = float(np.log10(n_all + ADD * (v_all + 1)))
    out = sums.groupBy("chunk").applyInArrow(_sum_pass(norm), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, crc_of(F.col("doc_id")) % 10 == 0)
