"""Sidecars: small JSON files beside data files, with size, mtime, hash and facts."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a sidecar adds to its file's name.
SUFFIX = ".twinfold.json"
MEDIA = "struct<width: int, height: int, duration_sec: double, capture_time: string, codec: string, frame_rate: string, format_name: string>"
SCHEMA = f"struct<size: bigint, mtime: bigint, md5: string, chunk_size: bigint, chunk_md5: array<string>, media: {MEDIA}>"


def is_sidecar(name: str, suffix: str = SUFFIX) -> bool:
    """A bare suffix is a name like any other."""
    return name.endswith(suffix) and len(name) > len(suffix)


def sidecar_path(path: Column, suffix: str = SUFFIX) -> Column:
    return F.concat(path, F.lit(suffix))


def is_sidecar_column(path: Column, suffix: str = SUFFIX) -> Column:
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return name.endswith(suffix) & (F.length(name) > len(suffix))


def parsed(texts: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """(path of the data file, size, mtime, md5, chunk_size, chunk_md5, media) of texts
    (path, value); broken JSON gives no row."""
    facts = texts.select(F.expr(f"left(path, length(path) - {len(suffix)})").alias("path"), F.from_json("value", SCHEMA).alias("s"))
    return facts.where("s is not null and s.size is not null").select("path", "s.*")


def read(spark, *folders: str, suffix: str = SUFFIX) -> DataFrame:
    """All sidecars below the folders, those of hidden files as well. Executors have to see them;
    what cannot be read or is no text counts as broken."""
    from . import walk

    def run(batches):
        for b in batches:
            texts = []
            for p in b.column("path").to_pylist():
                try:
                    with open(p, encoding="utf-8") as f:
                        texts.append(f.read())
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], ["path", "value"])

    found = walk.read(spark, list(folders), sidecars=True).where("error is null").select("path")
    return parsed(found.mapInArrow(run, "path string, value string"), suffix)


def json_text(facts: dict) -> str:
    """The text of a sidecar."""
    return json.dumps({k: v for k, v in facts.items() if v is not None}, indent=2) + "\n"
