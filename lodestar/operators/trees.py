"""Two states of a file tree: what changed, found through digests of folders.

A folder's digest covers the files in it (``own``) and all below it (``whole``). Two trees are compared
from the root: only folders whose parent differs are looked at, and files only where a folder's own
files differ, so what is read grows with what has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.lineage import stored


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, parent, own, whole) of every folder of ``files(path, digest)``; the root is the empty folder and has no parent."""
    each = files.select("path", F.xxhash64("path", "digest").cast("decimal(38,0)").alias("h"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("folder"), (n == F.size(steps) - 1).alias("direct")))
    rows = each.select("h", F.explode(above).alias("a")).groupBy("a.folder").agg(F.sum(F.when(F.col("a.direct"), F.col("h"))).alias("own"), F.sum("h").alias("whole"))
    parent = F.when(F.col("folder") != "", F.regexp_replace("folder", "/?[^/]*$", ""))
    return rows.select("folder", parent.alias("parent"), F.coalesce("own", F.lit(0).cast("decimal(38,0)")).alias("own"), "whole")


def changed_files(before: DataFrame | None, after: DataFrame, before_folders: DataFrame | None = None, after_folders: DataFrame | None = None) -> DataFrame | None:
    """(path, change) with added, changed and deleted files of two trees (path, digest); None if the earlier one is unknown.

    The folders' digests are made from the files where they are not given; whoever stores them reads
    only the files of folders that differ.
    """
    if before is None:
        return None
    old, new = before_folders or folder_digests(before), after_folders or folder_digests(after)
    both = stored(old.select("folder", "parent", F.col("own").alias("own_b"), F.col("whole").alias("whole_b")).join(new.select("folder", F.col("parent").alias("parent_a"), F.col("own").alias("own_a"), F.col("whole").alias("whole_a")), "folder", "full_outer")
                  .select("folder", F.coalesce("parent", "parent_a").alias("parent"), (~F.col("own_a").eqNullSafe(F.col("own_b"))).alias("own"), (~F.col("whole_a").eqNullSafe(F.col("whole_b"))).alias("whole")))
    level, found = both.where("parent is null and whole"), None
    while not level.isEmpty():
        level = stored(level)
        found = level if found is None else found.unionByName(level)
        level = both.where("whole").join(level.select(F.col("folder").alias("parent")), "parent", "left_semi").select(level.columns)
    if found is None:
        return after.limit(0).select("path", F.lit("changed").alias("change"))
    folders = found.where("own").select("folder")
    inside = lambda files: files.withColumn("folder", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")).join(folders, "folder", "left_semi").select("path", "digest")
    met = inside(before).withColumnRenamed("digest", "b").withColumn("in_b", F.lit(True)).join(inside(after).withColumnRenamed("digest", "a").withColumn("in_a", F.lit(True)), "path", "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return met.select("path", change.alias("change")).where("change is not null")
