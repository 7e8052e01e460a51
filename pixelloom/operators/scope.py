"""Where a search looks: this folder, its branch or all known folders, the own one first; and a search that reads no more folders than it must."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import under_root
from ..functions.vectors import normalised
from ..sources.scratch import stored

FOLDER, BRANCH, ALL = "folder", "branch", "all"


def scope(folders: DataFrame, home: str, where: str = ALL, path: str = "path") -> DataFrame:
    """(path, own): the folders to search. The own folder always is one of them, known or not, and comes first where own is sorted descending; case is ignored."""
    if where not in (FOLDER, BRANCH, ALL):
        raise ValueError(where)
    p, own = F.col(path), F.lower(F.lit(home.rstrip("/")))
    known = folders.select(F.rtrim(p, F.lit("/")).alias("path")).filter(F.col("path").isNotNull())
    wanted = F.lit(False) if where == FOLDER else under_root(F.col("path"), home.rstrip("/")) if where == BRANCH else F.lit(True)
    others = known.filter(wanted & (F.lower("path") != own)).groupBy(F.lower("path").alias("_key")).agg(F.min("path").alias("path")).select("path", F.lit(False).alias("own"))
    return folders.sparkSession.createDataFrame([(home.rstrip("/"), True)], "path string, own boolean").union(others)


def summaries(index: DataFrame, folder: str = "folder", vec: str = "embedding") -> DataFrame:
    """(folder, n, centre, reach): the unit mean of a folder's unit vectors, and the least cosine of one of them with it. Vectors of norm 1e-9 and below are left out."""
    unit = index.select(F.col(folder).alias("folder"), normalised(F.col(vec).cast("array<double>")).alias("v")).filter("v is not null and folder is not null")
    sums = unit.select("folder", F.posexplode("v").alias("p", "x")).groupBy("folder", "p").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    centre = sums.groupBy("folder").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s.x).alias("centre"))
    centre = stored(centre.withColumn("centre", normalised(F.col("centre"))), "scope-centres")
    return unit.join(centre, "folder").groupBy("folder", "n", "centre").agg(F.min(_dot(F.col("v"), F.col("centre"))).alias("reach"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bound(query: Column, centre: Column, reach: Column) -> Column:
    """The most that the cosine of a query with a vector of the folder can be: the angle to the centre, less the angle that the folder reaches. 1 where there is no centre."""
    angle = lambda c: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))
    return F.coalesce(F.cos(F.greatest(angle(_dot(query, centre)) - angle(reach), F.lit(0.0))), F.lit(1.0)) + 1e-9


def scoped_top_k(index: DataFrame, summary: DataFrame, folders: DataFrame, query: list[float], k: int, first: int = 4, key: str = "vec_id", folder: str = "folder", vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The k rows (key, folder, score) nearest to a query among the folders of scope(), and (path, own, bound) of the folders that were read.

    The own folder and the `first` others with the highest bounds are read; the k-th best score there tells which others can still hold
    a hit, and only those are read then. So hits are those of the full search. Ties go to the smaller key. Keep the index partitioned by folder, so that folders that are not read cost nothing.
    """
    unit = normalised(F.array(*(F.lit(float(x)) for x in query)))
    ranked = folders.join(summary, F.lower(folders["path"]) == F.lower(summary["folder"]), "left").select("path", "own", F.when(F.col("n").isNotNull(), bound(unit, F.col("centre"), F.col("reach"))).otherwise(F.lit(-2.0)).alias("bound"))
    ranked = stored(ranked, "scope-folders")

    def best(read: DataFrame) -> DataFrame:
        rows = index.join(F.broadcast(read.select(F.lower("path").alias("_path"))) if read is begun else read.select(F.lower("path").alias("_path")), F.lower(F.col(folder)) == F.col("_path"), "left_semi")
        score = _dot(normalised(F.col(vec).cast("array<double>")), unit)
        return rows.select(F.col(key), F.col(folder), score.alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(k)

    begun = stored(ranked.orderBy(F.desc("own"), F.desc("bound"), "path").limit(first + 1), "scope-begun")  # a fixed number of folders
    found = stored(best(begun), "scope-found")
    have = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    least = have["least"] if have["n"] == k else -2.0
    more = ranked.join(begun.select("path"), "path", "left_anti").filter(F.col("bound") >= least)
    out = found.unionByName(best(more)).orderBy(F.desc("score"), key).limit(k)
    return out, begun.unionByName(more)
