"""Reports of groups and tree pairs as lines, CSV rows and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import human_size

FORMATS = ("columns", "json", "csv", "simple")


def checked(kind: str) -> str:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r} (valid: {', '.join(FORMATS)})")
    return kind


def group_columns(nested: DataFrame) -> DataFrame:
    """Two copies on one line, more as a counted list (text of several lines)."""
    two = F.concat_ws("  |  ", F.col("files")[0], F.get("files", F.lit(1)), human_size(F.col("size")))
    many = F.concat(F.lit("# "), F.col("n").cast("string"), F.lit(" copies, "), human_size(F.col("size")), F.lit(" each\n  "), F.concat_ws("\n  ", "files"))
    return nested.select("gid", "size", F.when(F.col("n") == 2, two).otherwise(many).alias("text"))


def group_csv(nested: DataFrame) -> DataFrame:
    """size_bytes, size_human and the paths joined by bars (not escaped within paths)."""
    return nested.select(F.col("size").alias("size_bytes"), human_size(F.col("size")).alias("size_human"), F.concat_ws("|", "files").alias("files"))


def group_json(nested: DataFrame) -> DataFrame:
    return nested.select("gid", F.to_json(F.struct("size", "files")).alias("json"))


def group_simple(nested: DataFrame) -> DataFrame:
    """A line for each path and an empty one after each group, in order."""
    rows = nested.select("gid", "size", F.posexplode(F.concat("files", F.array(F.lit("")))).alias("line_no", "line"))
    return rows


def tree_csv(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit("tree").alias("type"), F.col("total_size").alias("size_bytes"), human_size(F.col("total_size")).alias("size_human"), "file_count", "dir_a", "dir_b")


def tree_json(pairs: DataFrame) -> DataFrame:
    return pairs.select("dir_a", "dir_b", F.to_json(F.struct("total_size", "file_count", F.array("dir_a", "dir_b").alias("dirs"))).alias("json"))


def tree_columns(pairs: DataFrame) -> DataFrame:
    """The text of a pair but for its number, which the order of output gives."""
    head = F.concat(human_size(F.col("total_size")), F.lit("  ("), F.col("file_count").cast("string"), F.lit(" files)"))
    return pairs.select("dir_a", "dir_b", "total_size", F.concat(head, F.lit("\n  "), "dir_a", F.lit("\n  "), "dir_b").alias("text"))


def write_groups(nested: DataFrame, kind: str, path: str) -> None:
    """A folder of files in the format; groups from the largest."""
    checked(kind)
    rows = nested.orderBy(F.desc("size"), "gid")
    if kind == "csv":
        group_csv(rows).write.csv(path, header=True, escape='"')
    elif kind == "json":
        rows.select("size", "files").write.json(path)
    elif kind == "columns":
        group_columns(rows).select("text").write.text(path)
    else:
        rows.select(F.concat(F.concat_ws("\n", "files"), F.lit("\n")).alias("text")).write.text(path)


def write_trees(pairs: DataFrame, kind: str, path: str) -> None:
    checked(kind)
    rows = pairs.orderBy(F.desc("total_size"), "dir_a", "dir_b")
    if kind == "csv":
        tree_csv(rows).write.csv(path, header=True, escape='"')
    elif kind == "json":
        rows.select("total_size", "file_count", F.array("dir_a", "dir_b").alias("dirs")).write.json(path)
    else:
        tree_columns(rows).select("text").write.text(path)
