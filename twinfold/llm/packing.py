"""Packing by Karmarkar-Karp multiway differencing.

A document's ids, an end id last, are cut into pieces of CAPACITY ids; full pieces are
sequences of their own. What is left of each document (under CAPACITY ids) is packed in
batches of about BATCH_IDS ids: every piece begins as a partial partition of k windows
with one of them filled; the two partitions of largest spread are merged, the fullest
window of one with the emptiest of the other, until one partition is left, whose
windows are near equal. k begins at the least count that could hold the batch; as long as
the fullest window is beyond CAPACITY, k rises and the batch is packed anew. Pieces that
are tiny against a batch are strung together first. Batches are dealt by a hash of the row
and its place, so equal rows are spread as any others and each task holds whole batches only.

Near-equal windows need a few small pieces, so half of the longer remainders (by their
ids' checksum) give up a sliver of 16 to 127 ids. It more than halves the padding.

Null texts are empty: one piece with the end id. Equal rows are packed each on its
own. Empty table: empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load, pick, plain, running_totals, tidy
from .tokens import encoded, encoder, vocabulary

CAPACITY, END = 2048, 1
#: Ids of a batch, about, and parts of a batch below which pieces are strung together.
BATCH_IDS, PARTS = 1 << 19, 1 << 14
#: Remainders of more ids than this may give up a sliver.
SLIVER_FROM = 512


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each piece."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    left, right = [-1] * n, [-1] * n
    # a partition: sums in falling order, and the node that holds each window's pieces
    # (-1: empty); trailing empty windows are not stored
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.array([s]), np.array([i])) for i, s in enumerate(sizes.tolist())}
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        (a, an), (b, bn) = parts.pop(i), parts.pop(j)
        if len(a) < len(b):
            a, an, b, bn = b, bn, a, an
        if len(a) + len(b) <= k:  # each filled window of one meets an empty one
            sums, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        else:
            both = len(a) + len(b) - k  # windows filled on both sides
            sums, nodes = np.empty(k, np.int64), np.empty(k, np.int64)
            sums[: len(a)], nodes[: len(a)] = a, an
            # b's largest go to the empty windows behind a, then to a's emptiest
            free = k - len(a)
            sums[len(a) :], nodes[len(a) :] = b[:free][::-1], bn[:free][::-1]
            at = np.arange(len(a) - 1, len(a) - 1 - both, -1)
            sums[at] += b[free:]
            fresh = np.arange(len(left), len(left) + both)
            left += nodes[at].tolist()
            right += bn[free:].tolist()
            nodes[at] = fresh
        o = np.argsort(-sums, kind="stable")
        sums, nodes = sums[o], nodes[o]
        parts[name] = (sums, nodes)
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), name))
        name += 1
    out = np.zeros(n, np.int64)
    for window, top in enumerate(parts.popitem()[1][1].tolist()):
        stack = [top]
        while stack:
            x = stack.pop()
            if left[x] < 0:
                out[x] = window
            else:
                stack += (left[x], right[x])
    return out


def strung(sizes: np.ndarray) -> np.ndarray:
    """The number of each piece's string: tiny neighbours (by number) share one, so that
    however small the pieces are there are about PARTS strings at most; others have their own."""
    unit = int(sizes.sum()) // PARTS
    tiny = sizes * 2 <= unit
    group = np.cumsum(np.where(tiny, sizes, 0)) // max(1, unit)
    name = np.where(tiny, group, int(group[-1]) + 1 + np.arange(len(sizes)))
    return np.unique(name, return_inverse=True)[1]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if sizes.max() > capacity or sizes.min() < 1:
        raise ValueError("a piece holds 1 to capacity ids")
    string = strung(sizes)
    total = np.bincount(string, weights=sizes).astype(np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(total, k)
        fill = np.bincount(window, weights=total, minlength=k)
        if fill.max() <= capacity:
            break
        k += 1
    window = window[string]
    o = np.argsort(window, kind="stable")
    before = np.cumsum(sizes[o]) - sizes[o]
    heads = np.concatenate([[0], np.cumsum(fill)[:-1]]).astype(np.int64)
    offset = np.empty(len(sizes), np.int64)
    offset[o] = before - heads[window[o]]
    return window, offset, k


def cuts(ids: np.ndarray, capacity: int = CAPACITY, sliver_from: int = SLIVER_FROM) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the rest, maybe a sliver of it."""
    n = len(ids)
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    start = len(out) * capacity
    rest = n - start
    if rest > max(sliver_from, 256):
        mark = zlib.crc32(ids[start:].tobytes())
        if mark & 1:
            sliver = 16 + (mark >> 1) % 112
            out.append((start, rest - sliver))
            start, rest = n - sliver, sliver
    if rest:
        out.append((start, rest))
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and its ids if asked for."""
    frame = plain(docs, "doc_id", "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches):
        for b in batches:
            held, row = [], []

            def batch():
                own = pick(b.column("doc_id")).take(pa.array(row, pa.int64()))
                c = list(zip(*held))
                more = [pa.array(c[4], pa.list_(pa.int64()))] if with_ids else []
                return pa.RecordBatch.from_arrays([own, *[pa.array(x, pa.int64()) for x in c[:4]], *more], names)

            for i, own_ids in enumerate(encoded(tokenizer, b.column("text"))):
                ids = np.append(own_ids, np.uint32(end)).astype("<u4", copy=False)
                for s, n in cuts(ids, capacity):
                    part = ids[s : s + n]
                    held.append((s, n, zlib.crc32(part.tobytes()), len(ids), *[part.tolist()] * with_ids))
                    row.append(i)
                if len(held) >= 20_000 or with_ids and len(held) >= 500:
                    yield batch()
                    held, row = [], []
            if held:
                yield batch()
        encoder(tokenizer).trim()

    shape = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return frame.mapInArrow(tidy(run), shape + ", ids array<long>" * with_ids)


def pack_pieces(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_up (with `length`, `start`, `doc_id`, `ids_crc32`) with sequence_id, gapless from
    0, and offset."""
    dealt = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    held = cut(cut_up.withColumn("batch", dealt))
    partial = held.where(F.col("length") < capacity).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    held = held.withColumn("batch", F.pmod("batch", F.lit(max(1, round(partial / BATCH_IDS)))))

    def assign(pdf):
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy()
        window, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        full, rest = np.flatnonzero(size == capacity), np.flatnonzero(size < capacity)
        window[full] = np.arange(len(full))
        w, offset[rest], _ = pack(size[rest], capacity)
        window[rest] = len(full) + w
        pdf["window"], pdf["offset"] = window, offset
        return pdf

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    packed = cut(held.groupBy("batch").applyInPandas(assign, f"{shape}, window long, offset long"))
    counts = packed.groupBy("batch").agg((F.max("window") + 1).alias("n"))
    firsts = running_totals(counts, "batch", "n", "first").select("batch", "first")
    return packed.join(firsts, "batch").withColumn("sequence_id", F.col("first") + F.col("window")).drop("batch", "window", "first")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (as many as are filled), and doc_ids, starts and lengths of the parts."""
    placed = pack_pieces(pieces(docs, tokenizer, capacity, end, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))


def op10_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_pieces(pieces(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
