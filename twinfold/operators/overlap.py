"""Partial overlap of directories: blocks of shared contents of two columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

BLOCK, LEAST = 30, 2


def _sides(member_rows: DataFrame, column: Column) -> DataFrame:
    """Groups whose files lie in exactly two columns; '' attributes a file to none."""
    rows = member_rows.withColumn("col", column).where("col is not null and col <> ''")
    two = rows.groupBy("gid", "size").agg(F.min("col").alias("col_a"), F.max("col").alias("col_b"))
    two = two.where("col_a <> col_b")
    # a third column lies strictly between the two
    third = rows.join(two.select("gid", "col_a", "col_b"), "gid").where("col <> col_a and col <> col_b").select("gid").distinct()
    return two.join(third, "gid", "left_anti")


def items(member_rows: DataFrame, column: Column, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """gid, size, col_a, col_b and block_no of every absorbed group. Column pairs of fewer than
    `least` (two at least) groups stay out. Blocks hold the largest groups first.

    A pair of large roots may hold most groups: they are numbered range by range."""
    block, least = block if block > 0 else BLOCK, max(2, least)
    shared = _sides(member_rows, column)
    enough = shared.groupBy("col_a", "col_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least).select("col_a", "col_b")
    rows = running(shared, ["col_a", "col_b"], [-shared["size"], shared["gid"]], F.lit(1), "k").join(enough, ["col_a", "col_b"])
    return rows.select("gid", "size", "col_a", "col_b", F.floor((F.col("k") - 1) / block).cast("int").alias("block_no"))


def blocks(item_rows: DataFrame) -> DataFrame:
    """One row for each block; shared bytes count one copy of each content."""
    return item_rows.groupBy("col_a", "col_b", "block_no").agg(F.count(F.lit(1)).alias("items"), F.sum("size").cast("long").alias("shared_bytes"))


def block_files(item_rows: DataFrame, member_rows: DataFrame, column: Column) -> DataFrame:
    """The files of the blocks, with `side` a or b; files of no column are left out."""
    rows = member_rows.withColumn("col", column).drop("size")
    side = F.when(F.col("col") == F.col("col_a"), "a").when(F.col("col") == F.col("col_b"), "b")
    return rows.join(item_rows, "gid").withColumn("side", side).where(F.col("side").isNotNull()).drop("col")


def remaining(group_ids: DataFrame, item_rows: DataFrame) -> DataFrame:
    """Groups that no block has absorbed."""
    return group_ids.join(item_rows.select("gid"), "gid", "left_anti")


def unattributed(item_rows: DataFrame, member_rows: DataFrame, column: Column) -> DataFrame:
    """For each block the files of its groups that lie in no column."""
    lost = member_rows.where(column.isNull() | (column == "")).select("gid")
    return lost.join(item_rows, "gid").groupBy("col_a", "col_b", "block_no").agg(F.count(F.lit(1)).alias("unattributed"))
