"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Every stage works on all that the stage before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import decontaminate, language, neardup, packing, substring
from twinfold.llm.common import load, plain, shared_dir
from twinfold.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Language models, packing and winnowing go beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others (no letters, or below the
    calibrated threshold) go."""
    return language.identify(docs, language.train(docs), COLUMNS).where("accepted").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard 0.8 or more on 5-word shingles) the document of
    smallest doc_id."""
    return neardup.keep_one(plain(docs, *COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that an earlier document has; documents of which
    nothing is left go. n_chars follows the text; a null text becomes empty."""
    got = substring.remove_repeats(docs, ("lang", "source", "n_chars"))
    got = got.where("n_removed = 0 or n_removed < n_words")
    count = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return got.select("doc_id", F.col("kept").alias("text"), "lang", "source", count.alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    got = decontaminate.hit_spans(docs, load(spark, sf_dir, "benchmark"), COLUMNS)
    return got.where(F.size("spans") == 0).select("row.*")


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of at most 2048 ids: a row for each piece."""
    placed = packing.pack_pieces(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packs),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    try:
        docs = load(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
            docs = spark.read.parquet(f"{top}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)  # has read all of docs when it returns
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
