"""What to dispose of: a ranked queue of actions, keep policies, and a plan that always
leaves one copy of each content.

All is a plan, a table of paths with an action; carrying it out is in effects.py.
Actions do not depend on the order in which they would be carried out: what any
action disposes of is decided by one order of preference for keeping, and a content of
which nothing would be left keeps its most preferred copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import removal_regex
from ..functions.scalars import cadence_prefix, cadence_rank, cadence_tail, swaps
from ..operators.trees import files_below

#: Kinds in the order of equal waste.
KINDS = ("tree", "overlap", "group")


def oriented(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pair's kept side as `keep`, the other as `drop`: the rarer backup is kept, else a."""
    turn = swaps(F.col(a), F.col(b))
    return pairs.withColumn("keep", F.when(turn, F.col(b)).otherwise(F.col(a))).withColumn("drop", F.when(turn, F.col(a)).otherwise(F.col(b)))


def queue(trees: DataFrame, block_rows: DataFrame, group_rows: DataFrame) -> DataFrame:
    """kind, waste, keep and drop of each action, in no order: see best_actions. group_rows:
    size, n, first_path, wasted."""
    t = oriented(trees, "dir_a", "dir_b").select(F.lit("tree").alias("kind"), F.lit(0).alias("kind_rank"), F.col("total_size").alias("waste"), "keep", "drop", F.col("file_count").alias("items"))
    o = oriented(block_rows, "col_a", "col_b").select(F.lit("overlap").alias("kind"), F.lit(1).alias("kind_rank"), F.col("shared_bytes").alias("waste"), "keep", F.concat_ws("#", "drop", "block_no").alias("drop"), "items")
    g = group_rows.select(F.lit("group").alias("kind"), F.lit(2).alias("kind_rank"), F.col("wasted").alias("waste"), F.col("first_path").alias("keep"), F.lit("").alias("drop"), F.col("n").alias("items"))
    return t.unionByName(o).unionByName(g)


def totals(queue_rows: DataFrame) -> DataFrame:
    return queue_rows.groupBy("kind").agg(F.count(F.lit(1)).alias("actions"), F.sum("waste").cast("long").alias("waste"))


def keep_order(member_rows: DataFrame) -> DataFrame:
    """member_rows with `rank`: rarer backups first if all members of the group differ in
    the cadence segment only, then root, then walk order."""
    path = F.col("path")
    context = member_rows.groupBy("gid").agg(
        (F.count(cadence_rank(path)) == F.count(F.lit(1))).alias("_all"),
        ((F.min(cadence_prefix(path)) == F.max(cadence_prefix(path))) & (F.min(cadence_tail(path)) == F.max(cadence_tail(path)))).alias("_same"),
    )
    rank = F.when(F.col("_all") & F.col("_same"), -cadence_rank(path)).otherwise(F.lit(0))
    return member_rows.join(context, "gid").withColumn("rank", F.struct(rank.alias("c"), F.col("source").alias("s"), F.split("path", "/").alias("k"))).drop("_all", "_same")


def best_copies(member_rows: DataFrame, *more: Column) -> DataFrame:
    """gid and `best`, the path of its most preferred copy (the first of keep_order), with other
    aggregates. One aggregate: a group of any size is combined before it is shuffled."""
    path = F.col("path")
    place = lambda c: F.struct(c.alias("c"), F.col("source").alias("s"), F.split("path", "/").alias("k"))
    same = (F.count(cadence_rank(path)) == F.count(F.lit(1))) & (F.min(cadence_prefix(path)) == F.max(cadence_prefix(path))) & (F.min(cadence_tail(path)) == F.max(cadence_tail(path)))
    best = F.when(same, F.min_by("path", place(-cadence_rank(path)))).otherwise(F.min_by("path", place(F.lit(0))))
    return member_rows.groupBy("gid").agg(best.alias("best"), *more)


def keep_first(member_rows: DataFrame) -> DataFrame:
    """gid, path, size and action: keep for the most preferred of each group, else dispose."""
    rows = member_rows.join(best_copies(member_rows), "gid")
    return rows.select("gid", "path", "size", F.when(F.col("path") == F.col("best"), "keep").otherwise("dispose").alias("action"))


def by_glob(member_rows: DataFrame, glob: str) -> DataFrame:
    """Matching copies go; if all match, the most preferred stays; if none does, all stay."""
    hit = F.col("path").rlike(removal_regex(glob))
    rows = member_rows.join(best_copies(member_rows, F.bool_and(hit).alias("every")), "gid")
    gone = hit & ~(F.col("every") & (F.col("path") == F.col("best")))
    return rows.select("gid", "path", "size", F.when(gone, "dispose").otherwise("keep").alias("action"))


def glob_side(pairs: DataFrame, a: str, b: str, glob: str) -> DataFrame:
    """The side that goes, `drop`: the matching one, if the other does not match."""
    hit = lambda c: F.col(c).rlike(removal_regex(glob))
    drop = F.when(hit(a) & ~hit(b), F.col(a)).when(hit(b) & ~hit(a), F.col(b))
    return pairs.withColumn("drop", drop).where(F.col("drop").isNotNull())


def tree_disposals(files: DataFrame, dropped: DataFrame) -> DataFrame:
    """Paths below dropped directories (column drop)."""
    return files_below(files, dropped.select(F.col("drop").alias("dir")).distinct()).select("path").distinct()


def dropped_files(sides: DataFrame) -> DataFrame:
    """Paths of oriented block files (with side, col_a, col_b) that lie on the side to drop."""
    return sides.where(F.col("drop") == F.when(F.col("side") == "a", F.col("col_a")).otherwise(F.col("col_b"))).select("path").distinct()


def tree_items(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """The items of tree actions: kind, keep, drop, path and size of each file below a dropped directory."""
    actions = pairs.select("keep", "drop").distinct()
    rows = files_below(files, actions.select(F.col("drop").alias("dir")).distinct()).select(F.col("dir").alias("drop"), "path", "size")
    return rows.join(actions, "drop").select(F.lit("tree").alias("kind"), "keep", "drop", "path", "size")


def group_items(member_rows: DataFrame) -> DataFrame:
    """The items of group actions: kind, keep (the most preferred copy), drop, path and size of the others."""
    rows = member_rows.join(best_copies(member_rows), "gid").where("path <> best")
    return rows.select(F.lit("group").alias("kind"), F.col("best").alias("keep"), F.lit("").alias("drop"), "path", "size")


def disposal_plan(files: DataFrame, wanted: dict[str, DataFrame], evidence: str = "content") -> DataFrame:
    """The plan: path, size, action, reason and evidence for each file that an action names.
    wanted: kind -> paths to dispose of. Every content (size, md5) of files keeps one copy:
    if all are named, the most preferred of them is kept with reason `survivor`."""
    named = None
    for k, kind in enumerate(KINDS):
        if kind in wanted:
            part = wanted[kind].select("path", F.lit(k).alias("k"))
            named = part if named is None else named.unionByName(part)
    if named is None:
        raise ValueError("no action")
    named = named.groupBy("path").agg(F.min("k").alias("k"))
    rows = files.select("path", "size", "md5", "source", F.concat_ws(":", "size", "md5").alias("gid")).join(named, "path", "left")
    # only contents that are named matter; of those, who is alive and who is preferred
    known = best_copies(rows, F.bool_or(F.col("k").isNull()).alias("alive"))
    rows = rows.where("k is not null").join(known, "gid")
    kept = ~F.col("alive") & (F.col("path") == F.col("best")) | F.col("md5").isNull()
    reason = F.when(kept, "survivor").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1))
    return rows.select("path", "size", F.when(kept, "keep").otherwise("dispose").alias("action"), reason.alias("reason"), F.lit(evidence).alias("evidence"))


def live_items(item_rows: DataFrame, block_file_rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Items of blocks of which both sides still have a copy; the others are moot."""
    live = block_file_rows.join(deleted.select("path"), "path", "left_anti").groupBy("gid").agg(F.bool_or(F.col("side") == "a").alias("a"), F.bool_or(F.col("side") == "b").alias("b"))
    return item_rows.join(live.where("a and b").select("gid"), "gid", "left_semi")


def live_groups(member_rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Members that are left, of groups of which two or more are."""
    left = member_rows.join(deleted.select("path"), "path", "left_anti")
    return left.join(left.groupBy("gid").agg(F.count(F.lit(1)).alias("left")).where("left > 1").select("gid"), "gid", "left_semi")


def best_actions(queue_rows: DataFrame, k: int) -> DataFrame:
    """The k actions that reclaim most."""
    return queue_rows.orderBy(F.desc("waste"), "kind_rank", "keep", "drop").limit(k)


def chosen(member_rows: DataFrame, picks: list[int]) -> DataFrame:
    """keep_first with an explicit choice: the places (from 0) that go; one copy stays."""
    w = Window.partitionBy("gid").orderBy("rank")
    rows = keep_order(member_rows).withColumn("place", F.row_number().over(w) - 1)
    every: Column = F.count(F.lit(1)).over(Window.partitionBy("gid"))
    rows = rows.withColumn("n_all", every)
    hit = F.col("place").isin(picks) & ~((F.col("place") == 0) & F.lit(len(picks)).__ge__(F.col("n_all")))
    return rows.select("gid", "path", "size", F.when(hit, "dispose").otherwise("keep").alias("action"))
