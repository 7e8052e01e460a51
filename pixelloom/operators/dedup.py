"""Exact duplicates of files: by size and name before content, by hash, by name; comparison of folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def keyed(files: DataFrame, same_name: bool) -> DataFrame:
    """Adds the comparison key: size, and the lower-case name where names must agree."""
    return files.withColumn("size_key", F.col("size")).withColumn("name_key", F.lower("name") if same_name else F.lit(""))


def with_possible_reference(candidates: DataFrame, references: DataFrame, same_name: bool = False) -> DataFrame:
    """Candidates whose key exists among the references. Only metadata is read; contents come later, for what is left."""
    keys = keyed(references, same_name).select("size_key", "name_key").distinct()
    return keyed(candidates, same_name).join(keys, ["size_key", "name_key"], "left_semi")


def duplicates_by_hash(candidates: DataFrame, references: DataFrame, content: str = "content", same_name: bool = False) -> DataFrame:
    """(id, reference_id, size): candidates that equal a reference byte by byte; the least reference id of each hash. Empty files must also agree in name."""
    kept = with_possible_reference(candidates, references, same_name)
    needed = with_possible_reference(references, candidates, same_name)
    sha = F.sha2(F.col(content).cast("binary"), 256)
    extra = F.when((F.col("size") == 0) | F.lit(same_name), F.lower("name")).otherwise(F.lit(""))
    firsts = needed.withColumn("sha", sha).withColumn("also", extra).groupBy("sha", "also").agg(F.min("id").alias("reference_id"))
    return kept.withColumn("sha", sha).withColumn("also", extra).join(firsts, ["sha", "also"]).select("id", "reference_id", "size")


def duplicates_by_name(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """(id, reference_id, size, reference_size, differing): the first reference with the same name; contents are not read."""
    firsts = references.groupBy(F.lower("name").alias("name_key")).agg(F.min_by(F.struct("id", "size"), "id").alias("r"))
    out = candidates.withColumn("name_key", F.lower("name")).join(firsts, "name_key")
    return out.select("id", F.col("r.id").alias("reference_id"), "size", F.col("r.size").alias("reference_size"), (F.col("size") != F.col("r.size")).alias("differing"))


def hash_groups(files: DataFrame, content: Column, key: str = "id") -> DataFrame:
    """(sha, members, first) of contents that occur more than once."""
    sha = F.sha2(content.cast("binary"), 256)
    return files.groupBy(sha.alias("sha")).agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first")).filter("members > 1")


def folder_equality(left: DataFrame, right: DataFrame, content: str = "content") -> DataFrame:
    """One row: contents only on the left, only on the right, and whether the folders hold the same."""
    sha = F.sha2(F.col(content).cast("binary"), 256)
    l, r = left.groupBy(sha.alias("sha")).agg(F.count(F.lit(1)).alias("nl")), right.groupBy(sha.alias("sha")).agg(F.count(F.lit(1)).alias("nr"))
    both = l.join(r, "sha", "full_outer")
    return both.agg(F.coalesce(F.sum(F.when(F.col("nr").isNull(), F.col("nl"))), F.lit(0)).alias("left_only"), F.coalesce(F.sum(F.when(F.col("nl").isNull(), F.col("nr"))), F.lit(0)).alias("right_only")).withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def folder_comparison(left: DataFrame, right: DataFrame, content: str = "content", place: str = "place") -> DataFrame:
    """One row about two folders of files (id, content, place): left and right files, how many lefts have no partner, distinct rights that are someone's
    partner, rights that are nobody's, unreadable files (null contents), whether the folders hold the same, and whether equal files lie in the same places.

    The partner of a left file is a right one of equal content, the one in the same place (case ignored) if there is one, else the one of the least id.
    """
    known = lambda df: df.filter(F.col(content).isNotNull()).select("id", F.lower(place).alias("place"), F.sha2(F.col(content).cast("binary"), 256).alias("sha"))
    l, r = known(left), known(right)
    first = r.groupBy("sha").agg(F.min("id").alias("first"))
    same = r.groupBy("sha", "place").agg(F.min("id").alias("same"))
    hits = l.join(first, "sha", "left").join(same, ["sha", "place"], "left").withColumn("partner", F.coalesce("same", "first"))
    hits = hits.agg(F.count("partner").alias("hit"), F.count_distinct("partner").alias("matched"), F.count_if(F.col("partner").isNotNull() & F.col("same").isNull()).alias("moved"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.count_if(F.col(content).isNull()).alias(f"{name}_unreadable"))  # noqa: E731  one row each
    out = hits.crossJoin(F.broadcast(count(left, "lefts"))).crossJoin(F.broadcast(count(right, "rights")))
    out = out.select("lefts", "rights", (F.col("lefts") - F.col("hit")).alias("without_partner"), "matched", F.greatest(F.lit(0), F.col("rights") - F.col("matched")).alias("right_only"), (F.col("lefts_unreadable") + F.col("rights_unreadable")).alias("unreadable"), "moved")
    equal = (F.col("lefts") > 0) & (F.col("without_partner") == 0) & (F.col("right_only") == 0) & (F.col("unreadable") == 0)
    return out.withColumn("equal", equal).withColumn("same_places", F.col("equal") & (F.col("moved") == 0)).drop("moved")


def matched(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """Every hit (hit, path, name) with its list row (row_id, path, name): by path, else by name (first row wins), else null."""
    by_path = listed.groupBy(F.lower("path").alias("lp")).agg(F.min("row_id").alias("r1"))
    by_name = listed.groupBy(F.lower("name").alias("ln")).agg(F.min("row_id").alias("r2"))
    out = hits.join(by_path, F.lower(hits["path"]) == by_path["lp"], "left").join(by_name, F.lower(hits["name"]) == by_name["ln"], "left")
    return out.select("hit", "path", F.coalesce("r1", "r2").alias("row_id"))


def lookup(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """matched(), with one hit for each path: the first in hit order."""
    first = Window.partitionBy(F.lower(F.col("path"))).orderBy("hit")
    return matched(hits, listed).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def content_blocks(table: DataFrame, key: str = "id", content: str = "content") -> Callable[[DataFrame, int, int], DataFrame]:
    """A reader of blocks for equal_classes(), over a column of contents."""
    whole = table.select(F.col(key).alias("id"), F.col(content).cast("binary").alias("_content"))
    return lambda rows, start, length: rows.join(whole, "id").select("id", F.sha2(F.substring("_content", start + 1, length), 256).alias("digest"))


def equal_classes(files: DataFrame, block: Callable[[DataFrame, int, int], DataFrame], first: int = 4096, growth: int = 16) -> tuple[DataFrame, list[int]]:
    """(id, class_id, members) of files that equal another byte by byte, class_id being the least id of the class; and the bytes read in each round.

    files: (id, size). Partition refinement: files of one size are one class at first; a round reads the next block of all files that still share their class
    with another and splits classes by its digest. Blocks grow by a factor, so rounds follow the logarithm of the largest size, and
    a file that differs early is read no further. block(rows, start, length) gives (id, digest) of a block of these files; files that it
    can't read drop out. Files without id or size are left out, empty files of one size are equal without being read.
    """
    rows, start, length, read = files.select("id", "size", F.col("size").cast("string").alias("class")).dropna(), 0, first, []
    done = None
    while True:
        shared = rows.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("class_id")).filter("members > 1")
        rows = stored(rows.join(shared, "class"), "equal-classes")
        whole = rows.filter(F.col("size") <= start).select("id", "class_id", "members")
        done = whole if done is None else done.union(whole)
        rows = rows.filter(F.col("size") > start)
        bytes_ = rows.agg(F.sum(F.least(F.col("size") - start, F.lit(length)))).first()[0]
        if not bytes_:
            return done, read
        read.append(int(bytes_))
        digests = block(rows.select("id"), start, length)
        rows = rows.join(digests, "id").select("id", "size", F.sha2(F.concat_ws(" ", "class", "digest").cast("binary"), 256).alias("class"))
        start, length = start + length, length * growth
