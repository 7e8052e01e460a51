"""Operations on file lists, planned as rows and never carried out on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, natural_key
from .order_stats import numbered


#: Names of the folders that sorted-out files go to.
TRIAGE_FOLDERS = ["kein_Fav", "KI_Fehler", "Doppelt", "Besonders", "Wasserzeichen"]


def in_triage(folder: Column) -> Column:
    """Whether a folder is one that sorted-out files go to; case is ignored."""
    return F.lower(file_name(F.rtrim(folder, F.lit("/\\")))).isin([n.lower() for n in TRIAGE_FOLDERS])


def existing(rows: DataFrame, scan: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(scan.select(F.lower(key).alias("_k")).distinct(), F.lower(rows[key]) == F.col("_k"), "left_semi")


def vanished(rows: DataFrame, scan: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(scan.select(F.lower(key).alias("_k")), F.lower(rows[key]) == F.col("_k"), "left_anti")


def move_plan(rows: DataFrame, target: DataFrame, marked: Column, name: str = "name") -> DataFrame:
    """(rows, action): unmarked rows move unless the target has their name."""
    names = target.select(F.lower(name).alias("_n")).distinct().withColumn("_there", F.lit(True))
    out = rows.join(names, F.lower(rows[name]) == F.col("_n"), "left")
    return out.withColumn("action", F.when(marked, "keep").when(F.col("_there"), "skip").otherwise("move")).drop("_n", "_there")


def delete_plan(hits: DataFrame, scan: DataFrame) -> DataFrame:
    """Hits (id, reference_id) whose reference is still there."""
    return hits.join(scan.select(F.col("id").alias("reference_id")).distinct(), "reference_id", "left_semi")


def next_in_order(names: DataFrame, after: str, name: str = "name") -> DataFrame:
    """One row: the first name after `after` in natural order, else the last. Two aggregates, no sort."""
    key = natural_key(F.col(name))
    later = F.min(F.when(key > natural_key(F.lit(after)), F.struct(key.alias("k"), F.col(name).alias("n"))))
    last = F.max(F.struct(key.alias("k"), F.col(name).alias("n")))
    return names.agg(F.coalesce(later, last).alias("x")).select(F.col("x.n").alias("next_name"))


def chunked(rows: DataFrame, order: Column, size: int = 5) -> DataFrame:
    """Adds the number of the chunk of `size` rows that a row falls into in the given order."""
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("position") / size)).drop("position")


def marked_totals(hits: DataFrame) -> DataFrame:
    """One row: marked, confirmed and not deleted hits, and their bytes."""
    live = F.col("marked") & ~F.col("name_only") & ~F.col("deleted")
    return hits.agg(F.count_if(live).alias("n_marked"), F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("marked_bytes"))


def latest(catalogue: DataFrame, updates: DataFrame, key: str, stamp: str) -> DataFrame:
    """Upsert: the newest row of each key."""
    both = catalogue.unionByName(updates)
    return both.groupBy(F.lower(key).alias("_k")).agg(F.max_by(F.struct(*both.columns), stamp).alias("r")).select("r.*")


def predicates(rows: DataFrame, moved: Column, parent: Column) -> DataFrame:
    """One row: any_moved, all_moved, and whether all rows share one parent folder (case ignored)."""
    some = F.coalesce(moved, F.lit(False))
    return rows.agg(F.bool_or(some).alias("any_moved"), F.bool_and(some).alias("all_moved"), (F.count_distinct(F.lower(parent)) == 1).alias("one_folder"))


def catalogue_totals(folders: DataFrame, there: DataFrame, key: str = "path") -> DataFrame:
    """One row: catalogued folders that exist, the sum of their images, and how many are missing."""
    marked = folders.join(there.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    is_there = F.col("_there").isNotNull()
    return marked.agg(F.count_if(is_there).alias("existing"), F.coalesce(F.sum(F.when(is_there, F.col("images"))), F.lit(0)).alias("images"), F.count_if(~is_there).alias("missing"))


def findings_summary(findings: DataFrame, visible: Column, metadata: Column) -> DataFrame:
    """One row: all findings, those with a visible mark, with metadata hints, and with either."""
    return findings.agg(F.count(F.lit(1)).alias("total"), F.count_if(visible).alias("visible"), F.count_if(metadata).alias("metadata"), F.count_if(visible | metadata).alias("any"))


def distinct_ignoring_case(rows: DataFrame, column: str) -> DataFrame:
    """(key, shown): one row for each value when case is ignored, shown as its first spelling in code point order; nulls are left out."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias("key")).agg(F.min(column).alias("shown"))


def undo_plan(moved: DataFrame, there: DataFrame, origin: str = "origin") -> DataFrame:
    """Moved rows with an action: back to their origin, or refused where something is there already (case ignored)."""
    taken = there.select(F.lower(origin).alias("_taken")).distinct()
    marked = moved.join(taken, F.lower(moved[origin]) == taken["_taken"], "left")
    return marked.withColumn("action", F.when(F.col("_taken").isNotNull(), F.lit("refuse")).otherwise(F.lit("move"))).drop("_taken")


def quartile(position: Column, count: Column) -> Column:
    """Quarter 1 to 4 of a list that the 0-based position lies in; null for an empty list."""
    return F.when(count > 0, F.least(F.greatest(F.ceil((position + 1) / count * 4), F.lit(1)), F.lit(4)))


def eighth(position: Column, count: Column) -> Column:
    """Eighths of a list that are reached at the 0-based position, at most 8; null for an empty list."""
    return F.when(count > 0, F.least(F.ceil((position + 1) / count * 8), F.lit(8)))


def newest_first(folders: DataFrame, stamp: str, key: str = "path") -> DataFrame:
    """Adds the position, from 0, by stamp, the newest first; of one stamp by key, case ignored."""
    return numbered(folders, F.coalesce(-F.unix_micros(F.col(stamp)), F.lit(0)) if dict(folders.dtypes)[stamp] == "timestamp" else -F.col(stamp), F.upper(key), key)


def largest_first(groups: DataFrame, members: str, key: str) -> DataFrame:
    """Adds the position, from 0, of groups by size, the largest first, then by key."""
    return numbered(groups, -F.col(members), key)


def first_files(files: DataFrame, n: int, folder: str = "folder", name: str = "name") -> DataFrame:
    """The first n rows by folder and name, case ignored; no more than n rows leave any task."""
    return files.orderBy(F.upper(folder), F.upper(name), folder, name).limit(n)


def folder_state(wanted: DataFrame, files: DataFrame, scanned: DataFrame) -> DataFrame:
    """(folder, files, bytes, empty) of each wanted folder, everything below it included: -1 files and 0 bytes where the scan did not find it. Case is ignored.

    scanned: (folder) that exist. A file counts for its folder and for all folders above it.
    """
    parts = F.split(F.lower("folder"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    sums = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).select(F.explode(above).alias("_f"), "n", "b").groupBy("_f").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    there = scanned.select(F.explode(above).alias("_s")).distinct()
    out = wanted.join(there, F.lower(wanted["folder"]) == F.col("_s"), "left").join(sums, F.lower(wanted["folder"]) == F.col("_f"), "left")
    n = F.when(F.col("_s").isNull() & F.col("n").isNull(), -1).otherwise(F.coalesce("n", F.lit(0)))
    return out.select("folder", n.cast("long").alias("files"), F.coalesce("b", F.lit(0)).alias("bytes"), (n == 0).alias("empty"))


def kept_with_unreadable(rows: DataFrame, found: DataFrame, unreadable: DataFrame, key: str = "path") -> DataFrame:
    """Rows of a list that were found or that nothing could be said of, each once."""
    keep = found.select(F.lower(key).alias("_k")).union(unreadable.select(F.lower(key))).distinct()
    return rows.join(keep, F.lower(rows[key]) == F.col("_k"), "left_semi")
