"""The hash cache: a Parquet folder of appended rows, compacted to one row a path."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hashing import CACHE, latest


def default_folder(environ=os.environ) -> str:
    base = environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(base, "twinfold", "hashes.parquet")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows, or none where there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder)


def append(hashed: DataFrame, folder: str, now: int) -> None:
    """Adds what was read in this run; runs at the same time only add files."""
    new = hashed.where("hash_origin = 'read' and md5 is not null")
    new.select("path", "size", "mtime", "inode", "md5", F.lit(now).cast("long").alias("seen")).write.mode("append").parquet(folder)


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """One row a path, in another folder: the old one stays until the caller changes over."""
    latest(read(spark, folder)).write.mode("overwrite").parquet(target)
