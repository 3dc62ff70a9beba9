"""Sharding: weighted rendezvous hashing of stable record keys.

Every shard gets a score for a key, -ln(u) / weight with u from a hash of key and
shard; the smallest wins. A further shard wins its share of keys and moves no
other. All expressions are built-in functions; three narrow shuffles number the rows.

Nulls: a null key is the key '' ; a null text has no bytes. Equal rows get equal
shards and different slots. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, plain

SHARDS = 40
#: Rows of one shard that one task numbers, about.
SLOT_ROWS = 50_000


def uniform(key: Column, shard: int, seed: str = "shard") -> Column:
    """52 bits of the XXH64 of "seed:shard:key", as a number above 0 and below 1."""
    digest = F.xxhash64(F.concat(F.lit(f"{seed}:{shard}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.shiftrightunsigned(digest, 12).cast("double") + 0.5) / float(1 << 52)


def _free(df: DataFrame, *names: str) -> None:
    if taken := [n for n in names if n in df.columns]:
        raise ValueError(f"columns that this adds are there already: {', '.join(taken)}")


def assign(df: DataFrame, key: str, weights: list[float], seed: str = "shard") -> DataFrame:
    """df with `shard` (from 0) and `grown_shard`: the shard with one more of mean weight. Other
    columns may have any names."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, and at least one")
    _free(df, "shard", "grown_shard")
    n = len(weights)
    score = lambda i, w: -F.log(uniform(df[key], i, seed)) / float(w)
    each = [F.struct(score(i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    best = F.least(*each) if n > 1 else each[0]
    out = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), best.alias("best"), score(n, sum(weights) / n).alias("new"))
    grown = F.when(F.col("new") < F.col("best.s"), F.lit(n)).otherwise(F.col("best.i"))
    return out.select("row.*", F.col("best.i").cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))


def number(df: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """df (of columns that can be grouped by) with `slot`, gapless from 0 in each group, in
    whatever order. A group is split by a hash of the order columns into parts of about
    SLOT_ROWS rows, whose counts (few) give offsets. Equal rows are one row with a count until
    the end, so however many there are they burden no task."""
    _free(df, "slot")
    parts = max(1, -(-rows // (SHARDS * SLOT_ROWS)))
    one = df.groupBy(F.struct(*[df[c] for c in df.columns]).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    own = [F.col("row").getField(c) for c in order]
    one = one.select("row", "n", F.col("row").getField(group).alias("g"), F.pmod(F.xxhash64(*own), F.lit(parts)).cast("int").alias("part"))
    counts = one.groupBy("g", "part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "part", before(Window.partitionBy("g").orderBy("part")).alias("off"))
    ranked = one.withColumn("rn", before(Window.partitionBy("g", "part").orderBy(*own, "row")))
    first = F.col("off") + F.col("rn")
    placed = ranked.join(counts, ["g", "part"]).select("row", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"))
    return placed.select("row.*", F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Documents without their texts, with shard, slot and the shard after growth."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(
        docs["doc_id"],
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = assign(base, "doc_id", weights or [1.0] * SHARDS)
    rows = plain(docs, "doc_id").count()
    return number(out, "shard", ["doc_id", "size", "text_crc32"], rows)


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
