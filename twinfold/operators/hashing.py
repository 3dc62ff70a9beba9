"""Content hashes from the cheapest source: fresh sidecar, then cache, then reading.

Files are only read after both joins have left them without a hash, so the Python stage
sees no other row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE = "path string, size bigint, mtime bigint, inode bigint, md5 string, seen bigint"
CHUNK = 64 << 20


def latest(cache: DataFrame) -> DataFrame:
    """One row for each path: the last that was seen."""
    rows = cache.groupBy("path").agg(F.max(F.struct("seen", "md5", "size", "mtime", "inode")).alias("c"))
    return rows.select("path", *[F.col(f"c.{k}").alias(k) for k in ("size", "mtime", "inode", "md5", "seen")])


def with_known_hashes(files: DataFrame, sidecars: DataFrame | None, cache: DataFrame | None, now: int, max_age: float = 0, rehash: bool = False) -> DataFrame:
    """files with md5 and hash_origin (sidecar, cache or null). A sidecar is fresh if size and
    mtime agree; a cache row if the inode agrees as well and it is not older than max_age
    seconds (0: never too old). rehash passes over the cache only."""
    base = files.drop("md5", "hash_origin")
    side = cached = F.lit(None).cast("string")
    if sidecars is not None:
        s = sidecars.select("path", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"), F.col("md5").alias("s_md5"))
        base = base.join(s.dropDuplicates(["path"]), "path", "left")
        side = F.when((F.col("s_size") == F.col("size")) & (F.col("s_mtime") == F.col("mtime")), F.nullif("s_md5", F.lit("")))
    if cache is not None and not rehash:
        c = latest(cache).select("path", *[F.col(k).alias(f"c_{k}") for k in ("size", "mtime", "inode", "md5", "seen")])
        base = base.join(c, "path", "left")
        same = (F.col("c_size") == F.col("size")) & (F.col("c_mtime") == F.col("mtime")) & (F.col("c_inode") == F.col("inode"))
        young = F.lit(max_age <= 0) | (F.lit(now) - F.col("c_seen") <= max_age)
        cached = F.when(same & young, F.col("c_md5"))
    out = base.withColumn("_s", side).withColumn("_c", cached)
    return out.select(
        *[c for c in files.columns if c not in ("md5", "hash_origin")],
        F.coalesce("_s", "_c").alias("md5"),
        F.when(F.col("_s").isNotNull(), "sidecar").when(F.col("_c").isNotNull(), "cache").alias("hash_origin"),
    )


def file_md5(path: str, chunk: int = CHUNK) -> str:
    digest = hashlib.md5(usedforsecurity=False)
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def read_hashes(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """files without md5 with the hash of their contents and hash_error. Each executor has to see
    the paths. Where `tasks` is given files are dealt out among them in turn, so that the largest
    do not meet (candidates come in order of size)."""
    names = files.columns

    def run(batches):
        for b in batches:
            md5, error = [], []
            for p in b.column("path").to_pylist():
                try:
                    md5.append(file_md5(p))
                    error.append(None)
                except OSError as e:
                    md5.append(None)
                    error.append(str(e))
            keep = [b.column(c) for c in names if c not in ("md5", "hash_origin")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(md5, pa.string()), pa.array(["read"] * b.num_rows), pa.array(error, pa.string())],
                [*[c for c in names if c not in ("md5", "hash_origin")], "md5", "hash_origin", "hash_error"],
            )

    dealt = files.repartition(tasks) if tasks else files
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name not in ("md5", "hash_origin"))
    return dealt.mapInArrow(run, f"{shape}, md5 string, hash_origin string, hash_error string")


def resolve(files: DataFrame, sidecars: DataFrame | None, cache: DataFrame | None, now: int, max_age: float = 0, rehash: bool = False, reader=None, tasks: int | None = None) -> DataFrame:
    """The whole cascade: files with md5, hash_origin and hash_error. tasks: how many read files."""
    known = with_known_hashes(files, sidecars, cache, now, max_age, rehash)
    rest = (reader or (lambda x: read_hashes(x, tasks)))(known.where("md5 is null"))
    return known.where("md5 is not null").unionByName(rest, allowMissingColumns=True)


def upserted(cache: DataFrame | None, hashed: DataFrame, now: int) -> DataFrame:
    """The cache after a run: what was read is new; a hit does not change `seen`."""
    new = hashed.where("hash_origin = 'read' and md5 is not null").select("path", "size", "mtime", "inode", "md5", F.lit(now).cast("long").alias("seen"))
    return new if cache is None else latest(cache.select(*new.columns).unionByName(new))


def statistics(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("hash_origin").agg(F.count(F.lit(1)).alias("n"))


def chunk_hashes(content: Column, size: int) -> Column:
    """MD5 of each part of `size` bytes of a binary column."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.md5(F.substring(content, i * size + 1, F.lit(size))))
