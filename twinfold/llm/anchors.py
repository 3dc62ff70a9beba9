"""What the two exact-substring operators share: anchors that meet by hash.

Rows of anchors are combined before they are shuffled: an anchor that occurs often
within one part of a task is marked there, and one row stands for it elsewhere. So a
passage in a third of all documents sends a few rows from each task to one place,
and its marked rows are dealt by document instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix

#: Least did of a row without doc_id; ids of documents lie below.
FIRST_NULL = 3 << 61

#: Anchor rows that are combined at a time.
FLUSH_ROWS = 600_000
#: Parts that the rows of one text are dealt into.
SALTS = 32
ANCHOR_SHAPE = "k long, m boolean, did long, pos int"
_ANCHOR = pa.schema([("k", pa.int64()), ("m", pa.bool_()), ("did", pa.int64()), ("pos", pa.int32())])


def keyed_texts(docs: DataFrame, rest: tuple[str, ...] = ()) -> DataFrame:
    """(did, text, rest): the id, the text, null as empty, and a struct of other columns. All
    uses select just these, so that Spark deals the texts out once and reads them again.
    Rows without an id would all meet in one place, so they are told apart by their texts:
    their did is FIRST_NULL or more, all of which rank alike, above every other."""
    nameless = F.lit(FIRST_NULL) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), nameless).alias("did"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
        F.struct(docs["doc_id"], *[docs[c] for c in rest]).alias("rest"),
    )


def copies(base: DataFrame) -> DataFrame:
    """For each did with a text that occurs more than once: `multi`, the hashes of
    those texts, and `copy`, of these the ones of which a smaller did exists. What is known
    of a text is dealt to SALTS tasks, so a text of a third of all rows is no task's alone."""
    hashed = base.select("did", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    groups = hashed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("low")).where("n > 1")
    groups = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = hashed.withColumn("s", F.pmod(F.xxhash64("did"), F.lit(SALTS)).cast("int")).join(groups, ["a", "b", "s"]).groupBy("did")
    return own.agg(F.collect_set("a").alias("multi"), F.collect_set(F.when(F.col("did") > F.col("low"), F.col("a"))).alias("copy"))


def with_copies(base: DataFrame, twins: DataFrame) -> DataFrame:
    """base with `multi` and `copy` as booleans."""
    a = F.xxhash64("text")
    joined = base.join(twins.hint("shuffle_hash"), "did", "left")
    has = lambda c: F.coalesce(F.array_contains(c, a), F.lit(False)).alias(c)
    return joined.select("did", "text", "rest", has("multi"), has("copy"))


def combine(h: np.ndarray, did: np.ndarray, pos: np.ndarray, by_doc: bool):
    """Rows to shuffle. A hash that stands here in two documents (by_doc) or two
    places marks its rows; the first of them goes on unmarked for the others' sake. A document
    that has one hash many times (a repeated word) marks all but the first at once: what is
    marked needlessly is compared needlessly, and nothing else."""
    o = np.lexsort((did, h)) if by_doc else np.argsort(h)
    h, did, pos = h[o], did[o], pos[o]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    heads = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    if by_doc:
        shared = np.minimum.reduceat(did, heads) != np.maximum.reduceat(did, heads)
    else:
        shared = np.diff(np.append(heads, len(h))) > 1
    m = shared[group]
    if by_doc:
        m[1:] |= (h[1:] == h[:-1]) & (did[1:] == did[:-1])
    spread = mix(did[m].view(np.uint64) + pos[m].astype(np.uint64) // np.uint64(64)).view(np.int64)
    rest = ~m | first
    return (
        np.concatenate([spread, h[rest].view(np.int64)]),
        np.concatenate([np.ones(len(spread), bool), np.zeros(int(rest.sum()), bool)]),
        np.concatenate([did[m], did[rest]]),
        np.concatenate([pos[m], pos[rest]]),
    )


class Anchors:
    """Gathers (hash, did, pos) and gives combined batches."""

    def __init__(self, by_doc: bool):
        self.by_doc, self.held, self.n = by_doc, [], 0

    def add(self, h, did, pos):
        if len(h):
            self.held.append((h, did, pos))
            self.n += len(h)
        if self.n >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self):
        if self.held:
            h, did, pos = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.n = [], 0
            k, m, did, pos = combine(h, did, pos.astype(np.int64), self.by_doc)
            for i in range(0, len(k), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[s]), pa.array(m[s]), pa.array(did[s]), pa.array(pos[s].astype(np.int32))], schema=_ANCHOR)


def shared_places(anchors: DataFrame, by_doc: bool) -> DataFrame:
    """For each did, `marks`: the places of its anchors that occur elsewhere as well."""
    w = Window.partitionBy("m", "k")
    shared = F.min("did").over(w) != F.max("did").over(w) if by_doc else F.count(F.lit(1)).over(w) > 1
    rows = anchors.withColumn("s", shared).where("m or s")
    return rows.groupBy("did").agg(F.collect_list("pos").alias("marks"))


def list_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column without structs; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [first, last)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(first, n), 1)
    np.add.at(step, np.minimum(last, n), -1)
    return np.cumsum(step[:n]) > 0
