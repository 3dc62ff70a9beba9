"""Cutting lineage: tables that later steps use several times."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where none is
    named one machine gets a temporary folder, which goes when the program ends; a cluster
    gets an error, as each of its machines would have a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="twinfold-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(at)
    return f"file://{at}"


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder: a later loss of executors costs no
    recomputation. Spark removes the files once nothing refers to the rows any more if
    spark.cleaner.referenceTracking.cleanCheckpoints is set (options.session does), else the
    folder's owner has to. narrow: a table of a few short columns, for which two files for
    each core are enough."""
    shared_dir(df.sparkSession)
    if narrow:
        df = df.coalesce(2 * max(1, df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint(eager=True)
