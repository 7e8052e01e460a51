"""Merkle manifest of a dataset: a tree for each source, a tree over their roots, and proofs for single rows.

The trees are built as a monoid of sparse forests. A forest holds unresolved nodes by tree, level and index. The
size of a tree tells how many siblings every run of nodes has, so a run is replaced by its parent as soon as all of them are there,
whichever forest they came from: merging is associative and commutative, and partitions may be split, read in any order or again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, sized, stored

ARITY = 16
#: Forests of so many neighbouring partitions, as a power of two, are merged by one task of a round.
FAN_IN = 4
_SCHEMA = "part long, kind string, tree string, n long, level int, idx long, hashes array<string>"
_ARROW = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hashes", pa.list_(pa.string()))])


def field(c: Column) -> Column:
    """A value as '-' for null, else its length in UTF-8 bytes, ':' and itself: no two rows of values read alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Forest:
    """Unresolved nodes; add() gives back the runs and roots that became whole."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.open = arity, {}

    def add(self, part: int, tree: str, n: int, level: int, idx: int, hash_: str) -> Iterator[tuple]:
        """One node of a tree of n leaves; gives (part, kind, tree, n, level, idx, hashes) for each run and root that is now known."""
        width = n
        for _ in range(level):
            width = -(-width // self.arity)
        while width > 1:
            run = idx // self.arity
            have = self.open.setdefault((tree, n, level, run), {})
            have[idx % self.arity] = (part, hash_)
            arity = min(self.arity, width - run * self.arity)
            if len(have) < arity:
                return
            del self.open[tree, n, level, run]
            hashes = [have[i][1] for i in range(arity)]
            yield part, "run", tree, n, level, run, hashes
            hash_ = hashlib.sha256("".join(hashes).encode()).hexdigest()
            level, idx, width = level + 1, run, -(-width // self.arity)
        yield part, "root", tree, n, level, 0, [hash_]

    def unresolved(self) -> Iterator[tuple]:
        for (tree, n, level, run), have in self.open.items():
            for i, (part, hash_) in have.items():
                yield part, "node", tree, n, level, run * self.arity + i, [hash_]

    def merge(self, other: Forest) -> list[tuple]:
        """Takes over the nodes of another forest; the runs and roots that this makes whole."""
        return [x for part, _, tree, n, level, idx, hashes in other.unresolved() for x in self.add(part, tree, n, level, idx, hashes[0])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind.type) for i, kind in enumerate(_ARROW)], schema=_ARROW)


def _planted(arity: int):
    """The forest of a partition of leaves: whole runs leave at once, unresolved nodes at the end."""

    def run(batches):
        forest = Forest(arity)
        for batch in batches:
            out = []
            for part, tree, n, idx, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += forest.add(part, tree, n, 0, idx, leaf)
            yield _batch(out)
        yield _batch([*forest.unresolved()])

    return run


def _merged(arity: int):
    def run(table: pa.Table) -> pa.Table:
        forest, out = Forest(arity), []
        for part, _, tree, n, level, idx, hashes in zip(*(table.column(c).to_pylist() for c in _ARROW.names), strict=True):
            out += forest.add(part, tree, n, level, idx, hashes[0])
        return pa.Table.from_batches([_batch(out + [*forest.unresolved()])])

    return run


class Trees(NamedTuple):
    """leaves: the input with part, idx and n; nodes: the runs and roots of all trees."""

    leaves: DataFrame
    nodes: DataFrame


def build_trees(leaves: DataFrame, order: list[str], arity: int = ARITY) -> Trees:
    """Trees over rows with (tree, leaf): the leaves of each tree in the given order, which should have no ties that matter.

    Leaves are dealt to sorted ranges, so that a large tree spreads over many; a leaf's index is its place
    in its range plus the leaves of its tree in the ranges before. Each range makes a forest; forests of neighbouring
    ranges are merged round by round, FAN_IN doublings at a time. A forest holds at most the borders of its ranges, arity - 1 nodes a
    level on either side, so no task and no driver ever holds a tree.
    """
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("part", F.shiftright("_at", 33)), "merkle-ranges")
    over = Window.partitionBy("tree")  # over the ranges of a tree
    spans = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    spans = stored(spans.select("tree", "part", "_first", (F.sum("_n").over(over.orderBy("part")) - F.col("_n")).alias("_before"), F.sum("_n").over(over).alias("n")), "merkle-spans")
    indexed = ranged.join(sized(spans), ["tree", "part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before")
    forest = stored(indexed.select("part", "tree", "n", "idx", "leaf").mapInArrow(_planted(arity), _SCHEMA), "merkle-forest")
    nodes, shift = forest.filter("kind <> 'node'"), FAN_IN
    while forest.filter("kind = 'node'").limit(1).count():
        group = F.shiftright("part", shift)
        forest = stored(forest.filter("kind = 'node'").groupBy(group.alias("group")).applyInArrow(_merged(arity), _SCHEMA), "merkle-merged")
        nodes, shift = nodes.union(forest.filter("kind <> 'node'")), min(shift + FAN_IN, 62)
    return Trees(indexed, nodes)


def _step(hashes: Column, place: Column) -> Column:
    """What stands left and right of a node in its run."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), place), "").alias("left"), F.array_join(F.slice(hashes, place + 2, F.greatest(F.size(hashes) - place - 1, F.lit(0))), "").alias("right"))


def with_paths(trees: Trees, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with `path`, the siblings on the way up as an array of (left, right), and all columns of `above` (tree, path): what lies above each root.

    The way goes down level by level; a run hands its path to its children, so no row meets more than `arity` others.
    """
    runs = trees.nodes.filter("kind = 'run'").select("tree", "n", "level", "idx", "hashes")
    known = [c for c in above.columns if c not in ("tree", "path")]
    top = runs.agg(F.max("level")).first()[0]
    path = None
    for level in range(-1 if top is None else top, -1, -1):
        here = runs.filter(F.col("level") == level).drop("level")
        is_top = F.col("n") <= arity ** (level + 1)
        found = here.filter(is_top).join(above, "tree").select("tree", "idx", "hashes", "path", *known)
        if path is not None:
            parent = path.select("tree", F.col("idx").alias("_up"), F.col("hashes").alias("_hashes"), F.col("path").alias("_path"), *known)
            own = here.filter(~is_top).withColumn("_up", F.floor(F.col("idx") / arity)).join(parent, ["tree", "_up"])
            step = _step(F.col("_hashes"), (F.col("idx") % arity).cast("int"))
            found = found.unionByName(own.select("tree", "idx", "hashes", F.concat(F.array(step), "_path").alias("path"), *known))
        path = found
    leaves = trees.leaves.drop("part")
    out = leaves.filter("n = 1").join(above, "tree")
    if path is not None:
        parent = path.select("tree", F.col("idx").alias("_up"), F.col("hashes").alias("_hashes"), F.col("path").alias("_path"), *known)
        many = leaves.filter("n > 1").withColumn("_up", F.floor(F.col("idx") / arity)).join(parent, ["tree", "_up"])
        step = _step(F.col("_hashes"), (F.col("idx") % arity).cast("int"))
        out = out.unionByName(many.withColumn("path", F.concat(F.array(step), "_path")).drop("_up", "_hashes", "_path"))
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s.left, acc, s.right).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "").cast("binary"), 256)


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", source: str = "source", also: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """(key, leaf, subroot, root, path[, also]) of every row: its digest, the root of its source, of the dataset, and its proof.

    A leaf is the SHA-256 of the row's values, each with its length; nodes are SHA-256 digests of their children's hexadecimal
    digests. Leaves of a source ascend by key (null first), rows with equal keys by leaf; equal rows are leaves of their own, in places that
    make no difference. Sources ascend by UTF-8 bytes, null first and a source like any other. Texts are
    hashed where they lie, whole and whatever their length; only digests are shuffled. `also` names further columns made of the input's,
    other columns of the input are left alone. An empty table gives an empty result.
    """
    also = also or {}
    slim = docs.select(F.col(key).alias("key"), field(F.col(source)).alias("tree"), digest(*(field(F.col(c)) for c in columns)).alias("leaf"), *(c.alias(f"_also_{k}") for k, c in also.items()))
    slim = stored(slim.withColumn("_salt", F.monotonically_increasing_id()), "merkle-leaves")  # a number tells equal rows apart, so that they may go to several ranges
    trees = build_trees(slim, ["key", "leaf", "_salt"], arity)
    value = F.when(F.col("tree") != "-", F.expr("substring(tree, locate(':', tree) + 1)"))
    roots = trees.nodes.filter("kind = 'root'").select(F.lit("").alias("tree"), value.alias("source"), F.col("tree").alias("of"), F.element_at("hashes", 1).alias("leaf"))
    top = build_trees(roots, ["source"], arity)
    root = top.nodes.filter("kind = 'root'").select("tree", F.element_at("hashes", 1).alias("root"))  # one row, or none
    none = F.array().cast("array<struct<left: string, right: string>>")
    above = with_paths(top, root.withColumn("path", none), arity).select(F.col("of").alias("tree"), F.col("leaf").alias("subroot"), "root", "path")
    out = with_paths(trees, stored(above, "merkle-sources"), arity)
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "path", *(F.col(f"_also_{k}").alias(k) for k in also))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents, and every row held against it after a change to the text of every fifth id (by crc32; a null id is not changed)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, digest(*(field(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c)) for c in COLUMNS)))
    rows = manifest(docs, COLUMNS, also={"tampered": tampered})
    out = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path"))).withColumn("proof_sha256", proof_digest(F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_RUN = "OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx ROWS BETWEEN {})"
_STEPS = f"""SELECT tree, level, idx, n, h, coalesce(string_agg(h, '') {_RUN.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l,
  coalesce(string_agg(h, '') {_RUN.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM """
_GROW = "SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY tree, level, idx // 16, n"
_TEXT = f"CASE WHEN 0 = x.crc % 5 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
#: DuckDB has no crc32; a table of its 256 steps is made by rule, and ids are folded digit by digit.
OP13_SQL = f"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), steps AS (
  SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8
), crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a >> 8, t[xor(a, c) % 256 + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), steps
), d AS (
  SELECT d.doc_id, source, coalesce(source, '') || (source IS NULL) AS tree, sha256({' || '.join(_FIELD.format(f'd.{c}') for c in COLUMNS)}) AS leaf,
    sha256({' || '.join(_FIELD.format(f'd.{c}') for c in COLUMNS[:-1])} || {_FIELD.format(f'({_TEXT})')}) AS tampered
  FROM documents d LEFT JOIN crcs x USING (doc_id)
), low AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d
), nodes(tree, level, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM low UNION ALL {_GROW.format('nodes')}
), way AS (
  {_STEPS} nodes
), subs AS (
  SELECT s.tree, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM (SELECT DISTINCT tree, source FROM d) s JOIN nodes w ON w.tree = s.tree AND w.n = 1
), tops(tree, level, idx, n, h) AS (
  SELECT 'top', 0, idx, n, h FROM subs UNION ALL {_GROW.format('tops')}
), topway AS (
  {_STEPS} tops
), up(tree, leaf, idx, pos, level, own, other, proof) AS (
  SELECT tree, leaf, idx, idx, 0, leaf, tampered, '' FROM low
  UNION ALL
  SELECT u.tree, u.leaf, u.idx, u.pos // 16, u.level + 1, sha256(l || own || r), sha256(l || other || r), proof || l || r
  FROM up u JOIN way w ON w.tree = u.tree AND w.level = u.level AND w.idx = u.pos AND w.n > 1
), whole AS (
  SELECT u.tree, u.leaf, u.idx, own AS subroot, other, proof FROM up u JOIN way w ON w.tree = u.tree AND w.level = u.level AND w.idx = u.pos AND w.n = 1
), top(tree, leaf, idx, subroot, pos, level, other, proof) AS (
  SELECT w.tree, leaf, w.idx, subroot, s.idx, 0, other, proof FROM whole w JOIN subs s USING (tree)
  UNION ALL
  SELECT u.tree, u.leaf, u.idx, subroot, u.pos // 16, u.level + 1, sha256(l || other || r), proof || l || r
  FROM top u JOIN topway w ON w.level = u.level AND w.idx = u.pos AND w.n > 1
)
SELECT low.doc_id, low.leaf, t.subroot, w.h AS root, sha256(t.proof) AS proof_sha256, t.other AS folded_root, t.other = w.h AS verified
FROM top t JOIN topway w ON w.level = t.level AND w.idx = t.pos AND w.n = 1 JOIN low ON low.tree = t.tree AND low.idx = t.idx
"""
