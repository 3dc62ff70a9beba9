"""Directory-level duplicates.

A file belongs to each directory from its root down to its parent (files x depth rows).
Directories get a fingerprint that does not depend on order; those of equal fingerprint and
count form a class, each verified entry by entry against the first of its class, so the work
is linear however many directories are equal. Pairs are made of verified classes: all of
them for classes of up to WHOLE directories, and beyond that the first directory with each
other one, which joins the same directories. Pairs below other pairs are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors_or_self, directories, is_below, parent, relative
from ..lineage import cut

#: Directories of a class up to which every two of them make a pair.
WHOLE = 2000
#: Distinct parents of a group, and levels, that the lifted coverage form looks at.
PARENT_CAP, LIFT = 50, 12

ENTRIES = {
    "fast": ("entry", "size", "mtime"),
    "content": ("entry", "size", "md5"),
}


def in_directories(files: DataFrame) -> DataFrame:
    """A row for each file and directory above it: dir, root, and `entry`, the path below dir."""
    rows = files.withColumn("dir", F.explode(directories(F.col("root"), F.col("relpath"))))
    return rows.withColumn("entry", relative(F.col("dir"), F.col("path")))


def fingerprints(rows: DataFrame, key: tuple[str, ...] = ENTRIES["fast"]) -> DataFrame:
    """dir, root, n, bytes and two sums of entry hashes; sums are exact and combine
    before the shuffle."""
    exact = lambda seed: F.sum(F.xxhash64(F.lit(seed), *key).cast("decimal(20,0)"))
    return rows.groupBy("dir", "root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"), exact(1).alias("fp1"), exact(2).alias("fp2")
    )


def _apart(a: Column, b: Column) -> Column:
    return ~is_below(a, b) & ~is_below(b, a)


def classes(prints: DataFrame, rows: DataFrame, key: tuple[str, ...], alike: tuple[str, ...] = ("n", "bytes", "fp1", "fp2"), matches: str = "n") -> DataFrame:
    """dir, root, n, bytes, class_id (the first directory of the class) and dirs (how many there
    are before verification) of the directories that equal another one. Directories agree in the columns
    `alike`, and as many of their rows (dir and key) as `matches` says are in the first
    directory as well; rows are distinct. One that does not agree (a collision of fingerprints) is left out."""
    tops = prints.groupBy(*alike).agg(F.min("dir").alias("class_id"), F.count(F.lit(1)).alias("dirs")).where("dirs > 1")
    named = cut(prints.join(tops, list(alike)))  # few rows, used three times
    mine = rows.select("dir", *key).join(named.select("dir", "class_id"), "dir")
    first = mine.where("dir = class_id").select("class_id", *key)
    agree = mine.join(first, ["class_id", *key]).groupBy("dir").agg(F.count(F.lit(1)).alias("agree"))
    good = named.join(agree, "dir").where(F.col("agree") == F.col(matches))
    return cut(good.select("dir", "root", "n", "bytes", "class_id", "dirs"))


def large_classes(class_rows: DataFrame, whole: int = WHOLE) -> DataFrame:
    """The classes that pairs_of gives as stars: class_id and dirs, for the log."""
    return class_rows.where(F.col("dirs") > whole).groupBy("class_id").agg(F.count(F.lit(1)).alias("dirs"))


def pairs_of(class_rows: DataFrame, whole: int | None = WHOLE) -> DataFrame:
    """Pairs dir_a < dir_b of each class, none within the other. Classes of over `whole`
    directories (None: no class) give a star: their first directory with each other one that
    lies below no other of the class."""
    small = class_rows if whole is None else class_rows.where(F.col("dirs") <= whole)
    a = small.select("class_id", F.col("dir").alias("dir_a"), F.col("root").alias("root_a"), F.col("n").alias("file_count"), F.col("bytes").alias("total_size"))
    b = small.select("class_id", F.col("dir").alias("dir_b"), F.col("root").alias("root_b"))
    out = a.join(b, "class_id").where((F.col("dir_a") < F.col("dir_b")) & _apart(F.col("dir_a"), F.col("dir_b")))
    if whole is not None:
        large = class_rows.where(F.col("dirs") > whole)
        above = large.withColumn("up", F.explode(ancestors_or_self(F.col("root"), F.col("dir")))).where("up <> dir").select("class_id", "dir", "up")
        inner = above.join(large.select("class_id", F.col("dir").alias("up")), ["class_id", "up"], "left_semi")
        outer = large.join(inner, ["class_id", "dir"], "left_anti")
        first = large.where("dir = class_id").select("class_id", F.col("dir").alias("dir_a"), F.col("root").alias("root_a"), F.col("n").alias("file_count"), F.col("bytes").alias("total_size"))
        star = first.join(outer.where("dir <> class_id").select("class_id", F.col("dir").alias("dir_b"), F.col("root").alias("root_b")), "class_id")
        out = out.unionByName(star.where(_apart(F.col("dir_a"), F.col("dir_b"))))
    return out.select("dir_a", "root_a", "dir_b", "root_b", "file_count", "total_size")


def without_dirs(df: DataFrame, dirs: DataFrame | None) -> DataFrame:
    return df if dirs is None else df.join(dirs.select("dir"), "dir", "left_anti")


def identical_classes(files: DataFrame, mode: str = "fast", incomplete: DataFrame | None = None, least: int = 2) -> DataFrame:
    """The classes of identical directories; mode fast (path, size, mtime) or content (path,
    size, md5; a directory with a file without hash is in none). incomplete: directories (dir)
    of which not all files are known."""
    rows, key = in_directories(files), ENTRIES[mode]
    prints = without_dirs(fingerprints(rows, key).where(F.col("n") >= least), incomplete)
    if mode == "content":
        prints = without_dirs(prints, unhashed(rows))
    return classes(prints, rows, key)


def undominated(pairs: DataFrame) -> DataFrame:
    """Pairs with no other pair at or above them on both sides, straight or crossed."""
    pairs = cut(pairs)  # used three times
    up = pairs.withColumn("up_a", F.explode(ancestors_or_self(F.col("root_a"), F.col("dir_a"))))
    up = up.withColumn("up_b", F.explode(ancestors_or_self(F.col("root_b"), F.col("dir_b"))))
    # a pair stands in its table with the smaller directory first
    up = up.select("dir_a", "dir_b", F.least("up_a", "up_b").alias("x"), F.greatest("up_a", "up_b").alias("y"))
    up = up.where((F.col("x") != F.col("dir_a")) | (F.col("y") != F.col("dir_b")))
    tops = pairs.select(F.col("dir_a").alias("x"), F.col("dir_b").alias("y"))
    beaten = up.join(tops, ["x", "y"], "left_semi")
    return pairs.join(beaten.select("dir_a", "dir_b").distinct(), ["dir_a", "dir_b"], "left_anti")


def identical_trees(files: DataFrame, mode: str = "fast", prune: bool = True, incomplete: DataFrame | None = None, seeds: DataFrame | None = None, least: int = 2, whole: int | None = WHOLE) -> DataFrame:
    """Pairs of identical directories (see identical_classes and pairs_of). seeds: pairs known
    before, which drop what is below them."""
    pairs = pairs_of(identical_classes(files, mode, incomplete, least), whole)
    if not prune:
        return pairs
    if seeds is None:
        return undominated(pairs)
    every = pairs.unionByName(seeds.join(pairs, ["dir_a", "dir_b"], "left_anti"), allowMissingColumns=True)
    return undominated(every).join(seeds, ["dir_a", "dir_b"], "left_anti")


def unhashed(rows: DataFrame) -> DataFrame:
    """Directories that hold a file without a hash: content cannot prove them equal."""
    return rows.where(F.col("md5").isNull()).select("dir").distinct()


def incomplete_directories(scanned: DataFrame) -> DataFrame:
    """scanned: all regular files, with `accepted`. Directories that hold one which is not."""
    return in_directories(scanned.where(~F.col("accepted"))).select("dir").distinct()


def covering_classes(files: DataFrame, member_rows: DataFrame, strict: bool = False, incomplete: DataFrame | None = None) -> DataFrame:
    """Classes of directories of equal file count that cover each other: all of their files are
    members of groups, and of the same groups. Paths are not compared. strict: each group has as
    many members in either, and the bytes agree."""
    own = ("gid", "c") if strict else ("gid",)
    held = in_directories(member_rows).groupBy("dir", "gid").agg(F.count(F.lit(1)).alias("c"))
    exact = lambda seed: F.sum(F.xxhash64(F.lit(seed), *own).cast("decimal(20,0)"))
    sets = held.groupBy("dir").agg(F.count(F.lit(1)).alias("g"), F.sum("c").alias("n"), exact(1).alias("fp1"), exact(2).alias("fp2"))
    stats = in_directories(files).groupBy("dir", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))
    prints = without_dirs(stats.join(sets, ["dir", "n"]), incomplete)  # as many members as files
    return classes(prints, held, own, ("n", "g", "fp1", "fp2", *["bytes"] * strict), "g")


def covering_trees(files: DataFrame, member_rows: DataFrame, prune: bool = True, strict: bool = False, incomplete: DataFrame | None = None, whole: int | None = WHOLE) -> DataFrame:
    """Pairs of directories that cover each other (see covering_classes); total_size is the first's."""
    pairs = pairs_of(covering_classes(files, member_rows, strict, incomplete), whole)
    return undominated(pairs) if prune else pairs


def lifted_trees(files: DataFrame, member_rows: DataFrame, prune: bool = True, parent_cap: int | None = PARENT_CAP, lift: int = LIFT, strict: bool = False, incomplete: DataFrame | None = None) -> DataFrame:
    """covering_trees as far as bounded candidates reach, for those who want no more than that:
    the first parent_cap parents of members of one group, lifted together up to `lift`
    levels. What lies beyond the bounds is not found."""
    home = member_rows.select("gid", "root", parent(F.col("path")).alias("dir")).distinct()
    if parent_cap:
        home = home.withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy("dir"))).where(F.col("k") <= parent_cap).drop("k")
    sides = [home.select("gid", F.col("dir").alias(f"dir_{s}"), F.col("root").alias(f"root_{s}")) for s in "ab"]
    near = sides[0].join(sides[1], "gid").where("dir_a < dir_b").select("dir_a", "root_a", "dir_b", "root_b").distinct()
    ups = [F.reverse(ancestors_or_self(F.col(f"root_{s}"), F.col(f"dir_{s}"))) for s in "ab"]
    lifted = near.select("root_a", "root_b", F.explode(F.slice(F.arrays_zip(ups[0].alias("a"), ups[1].alias("b")), 1, lift)).alias("z"))
    lifted = lifted.select("root_a", "root_b", F.col("z.a").alias("a"), F.col("z.b").alias("b")).where("a is not null and b is not null and a <> b").where(_apart(F.col("a"), F.col("b")))
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    pairs = lifted.select(pick("a", "b").alias("dir_a"), pick("root_a", "root_b").alias("root_a"), pick("b", "a").alias("dir_b"), pick("root_b", "root_a").alias("root_b")).distinct()

    stats = in_directories(files).groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))
    if incomplete is not None:
        stats = stats.join(incomplete, "dir", "left_anti")
    pairs = pairs.join(stats.select(F.col("dir").alias("dir_a"), F.col("n").alias("file_count"), F.col("bytes").alias("total_size")), "dir_a")
    pairs = pairs.join(stats.select(F.col("dir").alias("dir_b"), F.col("n").alias("file_count"), F.col("bytes").alias("bytes_b")), ["dir_b", "file_count"])
    pairs = pairs.where("total_size = bytes_b").drop("bytes_b") if strict else pairs.drop("bytes_b")
    # members of a group under a directory, counted: apart directories share no file
    held = in_directories(member_rows).groupBy("dir", "gid").agg(F.count(F.lit(1)).alias("c"))
    left = pairs.join(held.select(F.col("dir").alias("dir_a"), "gid", F.col("c").alias("ca")), "dir_a").select("dir_a", "dir_b", "gid", "ca")
    both = left.join(held.select(F.col("dir").alias("dir_b"), "gid", F.col("c").alias("cb")), ["dir_b", "gid"])
    if strict:
        both = both.where("ca = cb")
    total = both.groupBy("dir_a", "dir_b").agg(F.sum("ca").alias("sa"), F.sum("cb").alias("sb"))
    good = pairs.join(total, ["dir_a", "dir_b"]).where("sa = file_count and sb = file_count").drop("sa", "sb")
    good = good.select("dir_a", "root_a", "dir_b", "root_b", "file_count", "total_size")
    return undominated(good) if prune else good


def files_below(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """dirs (dir) with the files below each: an equi-join, not a range join."""
    return in_directories(files).join(dirs.select("dir"), "dir")
