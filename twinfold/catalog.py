"""The table of files and what turns other tables into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a table of files. `root` is the root that a file was found under, `relpath` its
#: path below; source is the root's place in the list of roots.
FILES = "path string not null, relpath string, root string, size bigint not null, mtime bigint, inode bigint, dev bigint, source int, md5 string"
COLUMNS = ("path", "relpath", "root", "size", "mtime", "inode", "dev", "source", "md5")
#: Roots of the made-up backup rotation.
ROTATION = ("/bk/daily-1", "/bk/weekly-1", "/bk/monthly-1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Each document as a file of one root: size in bytes, mtime n_chars, source from the
    number in the source's name."""
    text = F.coalesce("text", F.lit(""))
    rel = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    return docs.select(
        F.concat(F.lit("/corpus/"), rel).alias("path"),
        rel.alias("relpath"),
        F.lit("/corpus").alias("root"),
        F.octet_length(text).cast("long").alias("size"),
        F.col("n_chars").alias("mtime"),
        F.col("doc_id").alias("inode"),
        F.lit(1).cast("long").alias("dev"),
        F.substr("source", F.lit(4)).cast("int").alias("source"),
        F.md5(text.cast("binary")).alias("md5"),
    )


def backup_rotation(docs: DataFrame) -> DataFrame:
    """Every document in each of three roots, as backups hold them. A root has some
    documents in another folder (by the first digits of their hash), so not all trees agree."""
    files = documents_as_files(docs)
    roots = F.array(*[F.struct(F.lit(k).alias("source"), F.lit(r).alias("root")) for k, r in enumerate(ROTATION)])
    each = files.select("relpath", "size", "mtime", "inode", "dev", "md5", F.explode(roots).alias("r"))
    digits = F.substring("md5", 1, 2)
    moved = (digits == F.concat(F.lit("0"), F.col("r.source"))) | (digits == F.concat(F.lit("8"), F.col("r.source")))
    rel = F.when(moved, F.concat(F.lit("moved/"), F.col("relpath"))).otherwise(F.col("relpath"))
    return each.select(
        F.concat_ws("/", F.col("r.root"), rel).alias("path"), rel.alias("relpath"), F.col("r.root").alias("root"),
        "size", "mtime", "inode", "dev", F.col("r.source").alias("source"), "md5",
    )


def pages_as_paths(pages: DataFrame) -> DataFrame:
    """page_id and the path of its url, without scheme, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace("url", r"\A[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*\z", "")
    return pages.select("page_id", F.regexp_replace(bare, r"/+\z", "").alias("relpath"))


def with_roots(files: dict[str, DataFrame]) -> DataFrame:
    """The union of the files of several roots, in this order, each stamped with its place."""
    out = None
    for k, (root, df) in enumerate(files.items()):
        part = df.withColumn("root", F.lit(root)).withColumn("source", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one root")
    return out
