"""Helpers shared by the training-data operators.

Byte-level work is done with numpy over whole Arrow batches, in slices of a
bounded number of bytes, so that a Python worker's memory does not follow the
size of its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, shared_dir  # noqa: F401

#: Bytes of text that numpy works on at a time: what is made of them stays in the cache of a core.
SLICE_BYTES = 1 << 17
#: A null doc_id takes part as this largest value and is returned as null.
NULL_ID = (1 << 63) - 1

_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else (with whatever name) df has."""
    return df.select(*[df[n] for n in names])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row begins; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = 1 << max(21, (n - 1).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[name] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(_MULT)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, from prefix sums of a
    polynomial; equal spans have equal hashes wherever they stand. Spans can be made to collide,
    so it only chooses places, and what meets by it is compared."""
    v = values.astype(np.uint64)
    v += np.uint64(1 + salt)
    if values.dtype != np.uint8:
        v = mix(v)
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * _power(_BASE, len(v), "up"), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_BASE_INVERSE, len(v) + 1, "down")[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_MULT))


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """span_hashes of every run of n bytes."""
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    v = raw.astype(np.uint64)
    v += np.uint64(1)
    v *= _power(_BASE, len(v), "up")
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    h = total[n:] - total[:-n]
    h *= _power(_BASE_INVERSE, len(h), "down")
    h += np.uint64(n * _MULT & _ALL)
    return mix(h)


#: Bytes of a lane that belong to a word of so many bytes.
_TAKE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longest span whose lanes are mixed one by one; longer ones go through the XXH3 library.
LANE_BYTES = 256


def lanes_of(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw on, as one number; zeros follow the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each pair. Eight bytes at a time go through a
    full mix, so no arrangement of bytes cancels out whatever stands in them; a secret key
    keeps texts from being made to collide."""
    lanes, size = lanes_of(raw), ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(key & _ALL))
    long = np.flatnonzero(size > LANE_BYTES)
    if len(long):
        import xxhash

        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b].tobytes(), key & _ALL) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    left = np.flatnonzero(size <= LANE_BYTES) if len(long) else np.arange(len(size))
    at, rest = starts[left], size[left]
    while len(left):
        h[left] = mix(h[left] ^ (lanes[at] & _TAKE[np.minimum(rest, 8)]))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + (b ^ (b >> np.uint64(31))) * np.uint64(_BASE))


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n hashes: runs of twice the length are made of two halves,
    each step a full mix."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    m, out, have, size, power = len(values) - n + 1, None, 0, 1, values
    while True:
        if n & size:
            out = power if out is None else _join(out[: len(power) - have], power[have:])
            have += size
        size *= 2
        if size > n:
            return mix(out[:m] + np.uint64(n))
        power = _join(power[: -(size // 2)], power[size // 2 :])


#: ASCII white space: the separators of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray, separator: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and, for rows that begin at `at`,
    the number of words before each row. No word crosses a row."""
    inside = ~separator[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = at[(at > 0) & (at < len(raw))]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edge - 1] = inside[edge - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, at)


def tidy(run):
    """The same function over batches, which gives freed memory back to the system at the
    end of a task: workers are used again by later stages."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not every C library has it
            pass

    return tidied


def pick(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def ids_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pick(column).cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def running_totals(df: DataFrame, key: str, amount: str, out: str, block: int = 4096) -> DataFrame:
    """key (integer, one row each) and `out`, the sum of `amount` over all smaller keys.
    Two levels of windows: no task sorts more than `block` keys or the block totals."""
    from pyspark.sql import Window

    before = lambda w: F.coalesce(F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = df.select(df[key].alias("k"), F.floor(df[key] / block).alias("b"), df[amount].cast("long").alias("a"))
    tops = base.groupBy("b").agg(F.sum("a").alias("a"))
    tops = tops.select("b", before(Window.orderBy("b")).alias("t"))
    inner = base.withColumn("i", before(Window.partitionBy("b").orderBy("k")))
    return inner.join(tops, "b").select(F.col("k").alias(key), (F.col("t") + F.col("i")).cast("long").alias(out))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the smallest node that
    can be reached. Alternating large and small stars; each step is an aggregate
    (combined before the shuffle) and an equi-join, which Spark may split for
    nodes of high degree. Written to the shared folder after each round."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), narrow=True)
    for _ in range(most_rounds):
        # done when every node has one node above it, which has none: all trees are stars
        single = e.groupBy("u").count().where("count > 1").isEmpty()
        if single and e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty():
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), narrow=True)
    else:
        raise RuntimeError(f"components: not done after {most_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
