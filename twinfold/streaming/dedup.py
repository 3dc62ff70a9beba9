"""Streaming duplicates (an extension): events and files that come in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_events(events: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each combination of keys once; state is dropped when the watermark passes. Works on
    streams; on a batch it is a plain distinct of the keys' first rows."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in events.columns]), time).alias("e"))
    return first.select("e.*")


def repeats_by_window(events: DataFrame, keys: list[str], time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """For each tumbling window and key the number of events beyond the first."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    n = e.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("window_start"), *keys, (F.col("n") - 1).alias("repeats"))


def file_groups(batches, folder: str, key: tuple[str, ...] = ("size", "md5")):
    """A foreachBatch function: adds a micro-batch of files to a table in `folder` and gives
    `batches(groups)` the groups that it made or grew. A batch that is run again writes
    its own part again."""
    from ..operators.groups import groups

    def run(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        every = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/batch=*")
        touched = every.join(df.select(*key).distinct(), list(key), "left_semi")
        batches(groups(touched, key), number)

    return run
