"""Benchmark decontamination by winnowing.

Words are runs of digits, letters a-z (A-Z lowered) and bytes above ASCII. Both sides
hash every run of GRAM words and keep the least hash of each WINDOW of them, so a
shared span of GRAM + WINDOW - 1 = 10 words shares a kept hash. Kept hashes of
documents are looked up among those of the items, and each hit is extended to both
sides as far as the words agree; spans of 10 words or more count. Items of fewer
than 10 words have no such guarantee, so they are sought whole, by hashes of their length.
Every span is compared word for word before it counts.

Items go to the executors in blocks of at most BLOCK_BYTES of text. One block, the usual case,
needs one scan and no shuffle. Beyond that one scan finds the fingerprints of documents that
some item may have (by a bit table of fixed size), these are joined with the items' own,
and each block scans the few texts alone that share a fingerprint with an item of it. So
neither what is broadcast nor the number of scans of all documents grows with the benchmark.

Null texts have no words. Items without words never occur. Items with equal texts
all count. Equal document rows get equal results. Either table may be empty. Kept columns
come back in a struct, so they may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load, mix, pick, plain, slices, span_hashes, text_buffers, tidy, word_hashes, word_spans

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
BLOCK_BYTES = 4_000_000
#: Bits of a fingerprint that the table of a large benchmark's looks at: 2 MB of table.
BITS = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that separate words, after lower-casing.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def words_of(raw: np.ndarray, at: np.ndarray):
    """Lowered bytes, starts, ends and hashes of the words, words before each row."""
    low = _LOWER[raw]
    starts, ends, before = word_spans(low, _SEPARATOR, at)
    return low, starts, ends, word_hashes(low, starts, ends), before


def keep_least(h: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least of some window of WINDOW positions, ties included."""
    h = np.where(valid, h, np.uint64((1 << 64) - 1))
    if len(h) < WINDOW:
        return np.flatnonzero(valid)
    n = len(h) - WINDOW + 1
    least = h[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, h[k : k + n], out=least)
    kept = np.zeros(len(h), bool)
    for k in range(WINDOW):
        kept[k : k + n] |= h[k : k + n] == least
    return np.flatnonzero(kept & valid)


def gram_starts(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words, and whether it lies in one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    i = np.arange(m)
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    return span_hashes(hashes, i, i + n, salt=n), row[:m] == row[n - 1 :]


class Index:
    """The kept hashes of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], span: int = SPAN):
        texts = pa.array([t for _, t in items], pa.string())
        raw, at = text_buffers(texts)
        low, starts, ends, hashes, before = words_of(raw, at)
        self.ids = [k for k, _ in items]
        self.words = [[low[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(before[:-1], before[1:])]
        self.hashes = [hashes[a:b] for a, b in zip(before[:-1], before[1:])]
        self.long: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, h in enumerate(self.hashes):
            if len(h) >= span:
                g, ok = gram_starts(h, np.array([0, len(h)]), GRAM)
                for p in keep_least(g, ok).tolist():
                    self.long[int(g[p])].append((i, p))
            elif len(h):
                self.short[len(h)][int(gram_starts(h, np.array([0, len(h)]), len(h))[0][0])].append(i)
        self.long, self.short = dict(self.long), {n: dict(x) for n, x in self.short.items()}
        self.tables = {n: self._table(x) for n, x in [(0, self.long), *self.short.items()]}

    @staticmethod
    def _table(keys: dict) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, and a bit for each 16-bit prefix that occurs."""
        h = np.sort(np.array(list(keys), np.uint64))
        bits = np.zeros(1 << 16, bool)
        bits[(h >> np.uint64(48)).astype(np.int64)] = True
        return h, bits

    def find(self, h: np.ndarray, which: int) -> np.ndarray:
        """Positions of h that are in the table."""
        known, bits = self.tables[which]
        if not len(known):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        return maybe[known[at] == h[maybe]]

    def spans(self, low, starts, ends, hashes, before) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> (first word, word after the last, item) of matches, words counted from the row."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        word = lambda k: low[starts[k] : ends[k]].tobytes()
        g, ok = gram_starts(hashes, before, GRAM)
        kept = keep_least(g, ok)
        reach: dict[tuple[int, int, int], int] = {}
        for p in kept[self.find(g[kept], 0)].tolist():
            row = int(np.searchsorted(before, p, side="right")) - 1
            first, last = int(before[row]), int(before[row + 1])
            for item, q in self.long[int(g[p])]:
                key = (row, item, p - q)
                if reach.get(key, -1) >= p + GRAM:
                    continue
                own = self.words[item]
                a, c = p, q
                if any(word(p + k) != own[q + k] for k in range(GRAM)):
                    continue
                while a > first and c > 0 and word(a - 1) == own[c - 1]:
                    a, c = a - 1, c - 1
                b, d = p + GRAM, q + GRAM
                while b < last and d < len(own) and word(b) == own[d]:
                    b, d = b + 1, d + 1
                reach[key] = b
                if b - a >= SPAN:
                    found[row].append((a - first, b - first, item))
        for n in self.short:
            g, ok = gram_starts(hashes, before, n)
            hits = self.find(g, n)
            for p in hits[ok[hits]].tolist():
                row = int(np.searchsorted(before, p, side="right")) - 1
                for item in self.short[n][int(g[p])]:
                    if all(word(p + k) == w for k, w in enumerate(self.words[item])):
                        found[row].append((p - int(before[row]), p - int(before[row]) + n, item))
        return found


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """The items in blocks of bounded size, as they come from the executors."""
    held, size = [], 0
    for r in plain(benchmark, "item_id", "text").toLocalIterator():
        if held and size + len(r["text"] or "") * 4 > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") * 4 + 64
    yield held


def _scan(rows: DataFrame, items: list) -> DataFrame:
    """rows (row, text): row, n_words, and the hit spans and items of one block."""
    held = rows.sparkSession.sparkContext.broadcast(items)  # BLOCK_BYTES at most
    spans_type, items_type = pa.list_(pa.int64()), pa.list_(pa.string())

    def run(batches):
        index = Index(held.value)
        for b in batches:
            raw, at = text_buffers(b.column("text"))
            counts, spans, names = [], [], []
            for first, last in slices(at):
                part, own = raw[at[first] : at[last]], at[first : last + 1] - at[first]
                low, starts, ends, hashes, before = words_of(part, own)
                found = index.spans(low, starts, ends, hashes, before)
                counts += np.diff(before).tolist()
                for i in range(last - first):
                    x = found.get(i, ())
                    spans.append([v for s in merged([s[:2] for s in x]) for v in s])
                    names.append(sorted({str(index.ids[s[2]]) for s in x}))
            yield pa.RecordBatch.from_arrays([pick(b.column("row")), pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(names, items_type)], ["row", "n_words", "spans", "items"])

    shape = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, spans array<long>, items array<string>"
    return rows.select("row", "text").mapInArrow(tidy(run), shape)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Disjoint spans, in order, that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


# --- fingerprints of large benchmarks ------------------------------------------------


def _keys(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n words; 0 stands for the kept hashes of GRAM words."""
    return mix(h + np.uint64(n))


def _item_batches(batches):
    """(item, key, short) for each fingerprint of each item."""
    for b in batches:
        raw, at = text_buffers(b.column("text"))
        _, _, _, hashes, before = words_of(raw, at)
        out = []
        for k, i in zip(b.column("block").to_pylist(), range(b.num_rows)):
            h, whole = hashes[before[i] : before[i + 1]], np.array([0, before[i + 1] - before[i]])
            if len(h) >= SPAN:
                g, ok = gram_starts(h, whole, GRAM)
                out += [(k, x, 0) for x in np.unique(_keys(g[keep_least(g, ok)], 0)).view(np.int64).tolist()]
            elif len(h):
                out.append((k, int(_keys(gram_starts(h, whole, len(h))[0], len(h)).view(np.int64)[0]), len(h)))
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["block", "key", "short"])


def _document_keys(bits: np.ndarray, lengths: list[int]):
    """(a, b, key) of the fingerprints of texts that the bit table has."""

    def run(batches):
        for batch in batches:
            raw, at = text_buffers(batch.column("text"))
            a, b = (pick(batch.column(c)).to_numpy() for c in "ab")
            for first, last in slices(at):
                _, _, _, hashes, before = words_of(raw[at[first] : at[last]], at[first : last + 1] - at[first])
                for n in (0, *lengths):
                    g, ok = gram_starts(hashes, before, n or GRAM)
                    p = keep_least(g, ok) if n == 0 else np.flatnonzero(ok)
                    key = _keys(g[p], n)
                    p, key = (x[_has(bits, key)] for x in (p, key))
                    row = first + np.searchsorted(before, p, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(b[row]), pa.array(key.view(np.int64))], ["a", "b", "key"])

    return run


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bit_table(keys: DataFrame) -> np.ndarray:
    """One bit for each beginning of a key that occurs: 2 ** (BITS - 6) numbers at most."""
    at = F.shiftrightunsigned("key", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(key, {64 - BITS}), 64) as int))")
    words = keys.select(F.shiftright(at, 6).alias("w"), bit.alias("m"))
    out = np.zeros(1 << (BITS - 6), np.uint64)
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return out


# --- the operator ------------------------------------------------------------------


def hit_spans(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the kept columns), n_words, spans (flat list of first word and word after the
    last of each hit run) and items (ids as sorted strings), a row for each document."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["text"].alias("text"))
    held = blocks(benchmark)
    first, second = next(held), next(held, None)
    if second is None:
        return _scan(rows, first)
    return _by_fingerprint(rows, [first, second], held)


def _by_fingerprint(rows: DataFrame, ready: list, more) -> DataFrame:
    spark = rows.sparkSession
    named = rows.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(1), "text"))
    found, stored = None, []
    for at, block in enumerate(chain(ready, more)):  # a block is on the driver only while it is written
        items = spark.createDataFrame([(at, str(k), t) for k, t in block], "block int, item_id string, text string")
        stored.append(cut(items, narrow=True))
    every = stored[0]
    for x in stored[1:]:
        every = every.unionByName(x)
    keys = cut(every.mapInArrow(tidy(_item_batches), "block int, key long, short int").distinct(), narrow=True)
    lengths = sorted(r["short"] for r in keys.where("short > 0").select("short").distinct().collect())  # below SPAN
    bits = _bit_table(keys)
    met = named.select("a", "b", "text").mapInArrow(tidy(_document_keys(bits, lengths)), "a long, b long, key long").distinct()
    wanted = cut(met.join(keys.select("block", "key"), "key").select("a", "b", "block").distinct())
    texts = cut(named.select("a", "b", "text").join(wanted.select("a", "b").distinct(), ["a", "b"]).dropDuplicates(["a", "b"]))
    for k, items in enumerate(stored):
        own = texts.join(wanted.where(F.col("block") == k).drop("block"), ["a", "b"]).select(F.struct("a", "b").alias("row"), "text")
        part = _scan(own, [(r["item_id"], r["text"]) for r in items.collect()]).select("row.a", "row.b", "spans", "items")
        found = part if found is None else found.unionByName(part)
    flat = found.where(F.size("spans") > 0).groupBy("a", "b").agg(_merge(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = _scan(named.select(F.struct("row", "a", "b").alias("row"), "text"), []).select("row.row", "row.a", "row.b", "n_words")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return counted.join(flat, ["a", "b"], "left").select("row", "n_words", none("spans", "long"), none("items", "string"))


def _merge(lists: Column) -> Column:
    """Flat lists of disjoint spans as one such list."""
    pair = lambda s: lambda i: F.struct(s[2 * i].alias("a"), s[2 * i + 1].alias("b"))
    pairs = F.transform(lists, lambda s: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(s), 1) - 1), pair(s)))
    start = F.array().cast("array<long>")

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))  # null where there is none
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.greatest(last, x["b"])))
        return F.when(x["a"] <= last, joined).otherwise(F.concat(out, F.array(x["a"], x["b"])))

    return F.aggregate(F.array_sort(F.flatten(pairs)), start, step)


def op4_winnow_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hit_spans(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    ends = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
