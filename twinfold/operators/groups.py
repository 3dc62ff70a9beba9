"""File-level duplicates: collisions of size, groups, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import walk_key
from .ranks import running

#: What makes two files equal: without reading them, and by content.
FAST, CONTENT = ("size", "mtime"), ("size", "md5")


def _many(cross_root: bool) -> Column:
    """Two or more files, of two or more roots if asked for. Both are plain aggregates."""
    two = F.count(F.lit(1)) > 1
    return two & (F.min("source") != F.max("source")) if cross_root else two


def collision_sizes(files: DataFrame, cross_root: bool = False) -> DataFrame:
    """size and n of the sizes that several files have."""
    return files.groupBy("size").agg(F.count(F.lit(1)).alias("n"), _many(cross_root).alias("many")).where("many").drop("many")


def candidates(files: DataFrame, cross_root: bool = False) -> DataFrame:
    """Files whose size collides: all that need hashing. Sizes are combined before the
    shuffle, and their join can be split where one size is frequent."""
    return files.join(collision_sizes(files, cross_root).select("size"), "size", "left_semi")


def groups(files: DataFrame, key: tuple[str, ...] = CONTENT, cross_root: bool = False) -> DataFrame:
    """One row for each group: the key, n, wasted bytes and the first path. Files with a
    null in the key (no hash) are in none."""
    known = files.where(F.col(key[-1]).isNotNull() & (F.col(key[-1]).cast("string") != ""))
    out = known.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), _many(cross_root).alias("many"))
    return out.where("many").drop("many").withColumn("wasted", (F.col("size") * (F.col("n") - 1)).cast("long"))


def members(files: DataFrame, key: tuple[str, ...] = CONTENT, cross_root: bool = False) -> DataFrame:
    """The files of all groups, with `gid` and `n`."""
    found = groups(files, key, cross_root).select(*key, "n")
    return files.join(found, list(key)).withColumn("gid", F.concat_ws(":", *key))


def nested(member_rows: DataFrame) -> DataFrame:
    """One row for each group with its sorted paths in an array: for reports of small groups."""
    return member_rows.groupBy("gid", "size").agg(F.sort_array(F.collect_list("path")).alias("files"), F.count(F.lit(1)).alias("n"))


def reclaimable(group_rows: DataFrame) -> DataFrame:
    return group_rows.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("files"), F.coalesce(F.sum("wasted"), F.lit(0)).cast("long").alias("wasted"))


def files_per_root(files: DataFrame) -> DataFrame:
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))


def first_of_inode(files: DataFrame) -> DataFrame:
    """Without later names of a file met before, in the order of roots and walk. A null or
    zero inode is unknown and stays."""
    known = F.coalesce(F.col("inode"), F.lit(0)) != 0
    order = F.struct("source", F.split("path", "/").alias("k"))
    first = files.where(known).groupBy("dev", "inode").agg(F.min_by(F.struct("path", "source"), order).alias("f"))
    # a min_by is combined before the shuffle; a window over (dev, inode) would not be
    keep = first.select(F.col("f.path").alias("path"), F.col("f.source").alias("source"))
    return files.where(known).join(keep, ["path", "source"], "left_semi").unionByName(files.where(~known))


def largest_first(group_rows: DataFrame, key: tuple[str, ...] = CONTENT) -> DataFrame:
    return group_rows.orderBy(F.desc("size"), *key[1:])


def progress(sizes: DataFrame) -> DataFrame:
    """Collision sizes with the bytes done up to each, from the largest."""
    return running(sizes, [], [-sizes["size"]], sizes["size"] * sizes["n"], "done_bytes")


def walk_places(files: DataFrame) -> DataFrame:
    """files with `place`: from 1, in the order of a walk of their source."""
    return running(files, ["source"], [walk_key(files["path"])], F.lit(1), "place")


def without(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Files whose path is not among the skipped (deleted) ones."""
    return files.join(skipped.select("path"), "path", "left_anti")
