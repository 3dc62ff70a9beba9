"""Places and running sums in an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def running(df: DataFrame, group: list[str], order: list[Column], amount: Column, out: str) -> DataFrame:
    """df with `out`: the sum of amount over the rows of the same group up to and with this one.
    Rows are dealt by ranges of group and order, each range adds up its own, and the totals
    of ranges (as many as there are partitions) are added on top. order has to be total."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.struct(*[df[c] for c in group], F.lit(0).alias("_")).alias("g"), *[c.alias(f"o{k}") for k, c in enumerate(order)], amount.alias("x"))
    keys = [F.col(f"o{k}") for k in range(len(order))]
    dealt = cut(rows.repartitionByRange("g", *keys).withColumn("part", F.spark_partition_id()))
    tops = dealt.groupBy("g", "part").agg(F.sum("x").alias("x"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("g", "part", F.coalesce(F.sum("x").over(before), F.lit(0)).alias("off"))
    inner = Window.partitionBy("g", "part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("own", F.sum("x").over(inner)).join(tops, ["g", "part"])
    return placed.select("row.*", (F.col("off") + F.col("own")).cast("long").alias(out))
