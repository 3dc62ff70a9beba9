"""Token files: the Arrow stream format with fixed-size-list batches.

A part holds the documents of one range of doc_ids, in ascending order: a stream file of
(ids: fixed-size list, mask: fixed-size list of booleans), every batch of ROWS sequences
but the last, and a stream file of (doc_id, start, n_tokens) with starts within the
part. Only the last sequence of a part is padded, where the mask is false. Files are
not compressed, so a memory map gives sequences and masks without a copy: sequence
i is row i % ROWS of batch i // ROWS.

Ids are unsigned 16-bit numbers if the vocabulary fits, else 32-bit. Parts are written
under another name and moved, so a task that is run again leaves whole files.

Null texts are empty: one end id. A null doc_id comes last. Equal rows are written each.
Empty table: no part, empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import FIRST_NULL, keyed_texts
from .common import cut, load, pick, running_totals, shared_dir, tidy
from .tokens import encoded, encoder, vocabulary

LENGTH, ROWS, END = 2048, 256, 1
#: Bytes of text of a part, about.
PART_BYTES = 64_000_000
#: Parts that one task reads back, about.
PARTS_READ = 4
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_system(uri: str):
    """(file system, path) of a folder that executors share."""
    from pyarrow import fs

    if re.match(r"file:/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


class PartWriter:
    """Writes one part; close() gives the number of ids and documents."""

    def __init__(self, folder: str, part: int, dtype, length: int = LENGTH, end: int = END):
        self.fs, self.path = file_system(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.name, self.own = f"{self.path}/part-{part:06d}", f"{self.path}/.{part:06d}-{uuid.uuid4().hex}"
        self.dtype, self.length, self.end = np.dtype(dtype), length, end
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.files = [self.fs.open_output_stream(f"{self.own}.{k}") for k in ("tokens", "docs")]
        self.tokens = ipc.new_stream(self.files[0], self.schema)
        self.docs = ipc.new_stream(self.files[1], _INDEX)
        self.held, self.n_held, self.n, self.n_docs, self.index = [], 0, 0, 0, []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(self.end)).astype(self.dtype)
        self.index.append((doc_id, self.n, len(ids)))
        self.held.append(ids)
        self.n, self.n_held, self.n_docs = self.n + len(ids), self.n_held + len(ids), self.n_docs + 1
        if self.n_held >= ROWS * self.length:
            self._write(last=False)
        if len(self.index) >= 50_000:
            self._write_index()

    def _write(self, last: bool) -> None:
        ids, size = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype), ROWS * self.length
        at = 0
        while len(ids) - at >= size or last and at < len(ids):
            part = ids[at : at + size]
            filled, whole = len(part), -(-len(part) // self.length) * self.length
            mask = np.arange(whole) < filled
            part = np.concatenate([part, np.zeros(whole - filled, self.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.tokens.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            at += size
        self.held = [ids[at:]]
        self.n_held = max(0, len(ids) - at)

    def _write_index(self) -> None:
        if self.index:
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.index)], schema=_INDEX))
        self.index = []

    def close(self) -> tuple[int, int]:
        self._write(last=True)
        self._write_index()
        for x in (self.tokens, self.docs, *self.files):
            x.close()
        for k in ("docs", "tokens"):
            self.fs.move(f"{self.own}.{k}", f"{self.name}.{k}")
        return self.n, self.n_docs


class PartReader:
    """Random access to a part. All batches but the last are equally long in the file, so each is
    read from its place alone, whatever the file system; on a local or mounted folder it is a
    view of a memory map."""

    def __init__(self, folder: str, part: int):
        from pyarrow import fs

        self.fs, path = file_system(folder)
        name = f"{path}/part-{part:06d}"
        self.open_file = pa.memory_map if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file
        self.source, self.docs_name = self.open_file(f"{name}.tokens"), f"{name}.docs"
        self.schema = ipc.read_schema(self.source)
        self.first = self.source.tell()
        self.length = self.schema.field("ids").type.list_size
        self.step, self.held = None, (-1, None)

    def index(self):
        with self.open_file(self.docs_name) as f:
            yield from ipc.open_stream(f)

    def batch(self, i: int) -> pa.RecordBatch:
        """Batch i; the last one asked for is kept."""
        if self.held[0] != i:
            if self.step is None:
                self.source.seek(self.first)
                ipc.read_message(self.source)
                self.step = self.source.tell() - self.first
            self.source.seek(self.first + i * self.step)
            self.held = (i, ipc.read_record_batch(ipc.read_message(self.source), self.schema))
        return self.held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence i."""
        b, r = self.batch(i // ROWS), i % ROWS
        flat = b.column("ids").flatten().to_numpy()
        return flat[r * self.length : (r + 1) * self.length], b.column("mask").flatten().slice(r * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of the part: a view, unless they cross a batch."""
        size, out = ROWS * self.length, []
        while n:
            flat = self.batch(start // size).column("ids").flatten().to_numpy()
            part = flat[start % size : start % size + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, parts: int | None = None) -> DataFrame:
    """Writes all documents as parts of ascending doc_ids. One row for each part: part, n_ids,
    n_docs, which come to the driver as they are written (as many as there are parts, however
    many documents). Texts are dealt out once, by ranges, into `parts` or as many parts as
    their bytes need, if that is more than Spark's number of shuffle partitions."""
    spark = docs.sparkSession
    if parts is None:
        total = docs.agg(F.sum(F.octet_length(docs["text"]))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    base = keyed_texts(docs).withColumn("tie", F.xxhash64("text"))
    dealt = base.repartitionByRange(parts, "did", "tie").sortWithinPartitions("did", "tie").select("did", "text")

    def run(batches):
        part, out = TaskContext.get().partitionId(), None
        own = encoder(tokenizer)
        for b in batches:
            if not b.num_rows:
                continue
            out = out or PartWriter(folder, part, np.uint16 if own.size <= 1 << 16 else np.uint32)
            for d, ids in zip(b.column("did").to_pylist(), encoded(tokenizer, b.column("text"))):
                out.add(d, ids)
        own.trim()
        if out:
            n, docs_in = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([docs_in])], ["part", "n_ids", "n_docs"])

    shape = "part long, n_ids long, n_docs long"
    return spark.createDataFrame(dealt.mapInArrow(tidy(run), shape).collect(), shape)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, from the files."""
    first = running_totals(manifest, "part", "n_ids", "first").select("part", "first")

    def run(batches):
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("first").to_pylist()):
                reader = PartReader(folder, part)
                for x in reader.index():
                    start, n = x.column("start").to_numpy(), x.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(reader.ids(int(s), int(k)).astype("<u4").tobytes()) for s, k in zip(start, n)]
                    yield pa.RecordBatch.from_arrays([pick(x.column("doc_id")), pa.array(start + base), pick(x.column("n_tokens")), pa.array(crc, pa.int64())], ["did", "start", "n_tokens", "ids_crc32"])

    tasks = -(-max(1, manifest.count()) // PARTS_READ)
    rows = first.repartition(tasks).mapInArrow(tidy(run), "did long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.when(F.col("did") < FIRST_NULL, F.col("did"))).drop("did")


def op8_arrow_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes into the shared folder, reads all back, and takes the files away again."""
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, path = file_system(folder)
    try:
        manifest = write_tokens(load(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
        return cut(read_tokens(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32"))
    finally:
        from pyarrow.fs import FileType

        if fs.get_file_info(path).type == FileType.Directory:
            fs.delete_dir(path)
