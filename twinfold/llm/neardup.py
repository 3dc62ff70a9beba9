"""SimHash near-dedup of whole rows: one row of each group of near copies stays.

Near copies share 0.8 or more (Jaccard) of their distinct WORDS-word shingles. Words are
those of simhash: `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; texts of one to four words
are one shingle; texts without words are equal to each other.

1. Every set of shingles gets a fingerprint of 256 bits, each the majority of that bit in
   the shingles' hashes; texts with equal sets are one.
2. Fingerprints are compared in tiles, as in simhash: tiles and sub-tiles whose population
   counts differ beyond the radius, or whose set sizes rule 0.8 out, are skipped, the rest
   goes through exclusive-or and bit counts. Two sets of similarity 0.8 differ in 15 % of
   their bits; pairs within NEAR of the first 128 bits and WITHIN of all go on, which leaves
   out about one such pair in 100,000 (of sets of 4 or 5 shingles one in 500).
3. Only sets that have such a partner are compared again, tile by tile, now with the
   shingles at hand: pairs that are not yet of one group are checked exactly. A pair of
   tiles sends the stars of its groups, never all pairs.

The comparison of tiles is quadratic in the number of sets of like size, as the method is.
Shingles and sets are told apart by 64-bit hashes.

Null text has no words. Of a group the row of smallest doc_id stays; a null doc_id counts
as the largest; among equal ids one row stays. Columns may have any names. Empty table:
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, NULL_ID, components, cut, mix, pick, run_hashes, slices, text_buffers, tidy, word_hashes, word_spans
from .simhash import PAIR, Forest, Side, dealt_pairs, majority_bits, near_blocks, per_pair

WORDS = 5
#: Bits in which the first 128 and all 256 bits of two fingerprints may differ.
NEAR, WITHIN = 38, 70
LANES = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def similar(n, m, both):
    """Whether sets of n and m shingles with `both` in common have Jaccard 0.8 or more."""
    return 5 * both >= 4 * (n + m - both)


def shingle_sets(column: pa.Array):
    """For slices of the rows: the sorted distinct shingle hashes of all its rows one after
    another, and the bounds of each row."""
    raw, at = text_buffers(column)
    for first, last in slices(at):
        part, own = _LOWER[raw[at[first] : at[last]]], at[first : last + 1] - at[first]
        starts, ends, bound = word_spans(part, BLANK, own)
        words, size = word_hashes(part, starts, ends), np.diff(bound)
        each = np.where(size >= WORDS, size - WORDS + 1, np.minimum(size, 1))
        row = np.repeat(np.arange(last - first), each)
        a = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + bound[:-1][row]
        h = np.zeros(len(a), np.uint64)
        for n in range(1, WORDS + 1):
            mine = (np.minimum(size, WORDS) == n)[row]
            if mine.any():
                h[mine] = run_hashes(words, n)[a[mine]]
        o = np.lexsort((h, row))
        h, row = h[o], row[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield h, np.searchsorted(row, np.arange(last - first + 1))


def set_names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One value for each set; equal sets have equal values."""
    size = np.diff(at)
    if not len(h):
        return size
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(1)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64)


def fingerprints(h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """LANES times 64 bits for each set."""
    return [majority_bits(mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), size).view(np.int64) for k in range(LANES)]


_MARKED = "did long, a long, node long, n int, " + ", ".join(f"f{k} long" for k in range(LANES))
_BITS = [f"f{k}" for k in range(LANES)]


def _mark_batches(batches):
    for b in batches:
        parts = [(set_names(h, at), np.diff(at), *fingerprints(h, np.diff(at))) for h, at in shingle_sets(b.column("text"))]
        if parts:
            node, n, *bits = (np.concatenate(x) for x in zip(*parts))
            columns = [pick(b.column("did")), pick(b.column("a")), pa.array(node), pa.array(n.astype(np.int32)), *map(pa.array, bits)]
            yield pa.RecordBatch.from_arrays(columns, ["did", "a", "node", "n", *_BITS])


def _set_batches(batches):
    seen: set[int] = set()
    for b in batches:
        node, first = pick(b.column("node")).to_numpy(), 0
        for h, at in shingle_sets(b.column("text")):
            rows = []
            for i in range(len(at) - 1):
                if (name := int(node[first + i])) not in seen:
                    seen.add(name)
                    rows.append(i)
            if len(seen) > 300_000:
                seen.clear()
            held = pa.array([h[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node[first : first + len(at) - 1][rows]), held], ["node", "held"])
            first += len(at) - 1


def _sides(x: pa.Table, y: pa.Table | None):
    numbers = lambda t, c: t.column(c).to_numpy()
    base, out = 0, []
    for t in (x, y):
        if t is not None:
            fp = np.stack([numbers(t, c) for c in _BITS[:2]], 1).view(np.uint64)
            out.append(Side(fp, base, numbers(t, "n").astype(np.int64)))
            base += len(t)
    both = [t for t in (x, y) if t is not None]
    whole = [np.concatenate([numbers(t, c) for t in both]).view(np.uint64) for c in _BITS]
    node, n = (np.concatenate([numbers(t, c) for t in both]) for c in ("node", "n"))
    return out[0], out[-1], whole, node, n.astype(np.int64)


def _pairs(x: Side, y: Side, whole, n: np.ndarray, same: bool, wanted=None):
    """Rows of near pairs: one number and those that it may be similar to. wanted(i, j): which
    pairs of a block still matter."""
    for i, j, near in near_blocks(x, y, NEAR, same):
        if wanted is not None:
            near &= wanted(i, j)
        for u in np.flatnonzero(near.any(axis=1)):
            p, q = int(i[u]), j[near[u]]
            apart = sum(np.bitwise_count(w[p] ^ w[q]).astype(np.int64) for w in whole)
            q = q[(apart <= WITHIN) & similar(np.minimum(n[p], n[q]), np.maximum(n[p], n[q]), np.minimum(n[p], n[q]))]
            if len(q):
                yield p, q


def _partners(x: pa.Table, y: pa.Table | None) -> pa.Table:
    """Nodes with a partner in the other tile (or this one)."""
    if not len(x):
        return pa.table({"node": pa.array([], pa.int64())})
    left, right, whole, node, n = _sides(x, y)
    has = np.zeros(len(node), bool)
    open_pair = lambda i, j: ~(has[i][:, None] & has[j][None, :])
    for p, q in _pairs(left, right, whole, n, y is None, open_pair):
        has[p] = has[q] = True
    return pa.table({"node": node[has]})


def _groups(x: pa.Table, y: pa.Table | None) -> pa.Table:
    """Stars of the groups that the similar pairs of two tiles make."""
    if not len(x):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    left, right, whole, node, n = _sides(x, y)
    held = [h for t in (x, y) if t is not None for h in t.column("held").to_pylist()]
    forest = Forest(len(node))

    def shingles(k: int) -> np.ndarray:
        return np.frombuffer(held[k], np.uint64)

    apart = lambda i, j: forest.roots(i)[:, None] != forest.roots(j)[None, :]
    for p, q in _pairs(left, right, whole, n, y is None, apart):
        own = shingles(p)
        while True:
            q = q[forest.roots(q) != forest.roots(np.array([p]))[0]]  # a row may have been joined meanwhile
            if not len(q):
                break
            now, q = q[:64], q[64:]
            each = n[now]
            every = np.concatenate([shingles(k) for k in now.tolist()])
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(each) - each)
            good = now[similar(n[p], each, both)]
            if len(good):
                forest.join(forest.roots(np.append(good, p)))
    a, b = forest.stars(node)
    return pa.table({"a": a, "b": b})


def _dealt(rows: DataFrame, held: bool = False) -> DataFrame:
    """Tiles of sets of like size (a class spans a ratio of 5 to 4, so only neighbours can be
    similar) and like population count of the first 128 bits."""
    p = F.floor((F.bit_count("f0") + F.bit_count("f1")) / (NEAR + 1))
    s = F.floor(F.log("n") / math.log(1.25)) + 1
    return dealt_pairs(rows, p, s, 1, F.octet_length("held") if held else None)


def links(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) between nodes, enough to connect each group. texts: did, a, text."""
    first = F.min_by(F.struct("did", "a", "n", *_BITS), F.struct("did", "a"))
    nodes = cut(marked.where("n > 0").groupBy("node").agg(first.alias("r")).select("node", "r.*"), narrow=True)
    own = nodes.select("node", "n", *_BITS)
    partners = cut(_dealt(own).groupBy(*PAIR).applyInArrow(per_pair(_partners), "node long").distinct(), narrow=True)
    need = nodes.join(partners, "node")
    rows = texts.join(need.select("did", "a", "node").hint("shuffle_hash"), ["did", "a"]).select("node", "text")
    sets = rows.mapInArrow(tidy(_set_batches), "node long, held binary")
    held = cut(need.select("node", "n", *_BITS).join(sets, "node"))
    return _dealt(held, True).groupBy(*PAIR).applyInArrow(per_pair(_groups), "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group the one of smallest doc_id."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("whole")
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(docs["text"]).alias("a"), whole)
    texts = base.select("did", "a", F.col("whole.text").alias("text"))
    marked = cut(texts.mapInArrow(tidy(_mark_batches), _MARKED))
    named = marked.select("did", "a", "node").join(components(links(texts, marked)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min(F.struct("did", "a")).alias("k"))
    rows = marked.groupBy("did", "a").agg(F.count(F.lit(1)).alias("copies"))
    stay = best.select("k.did", "k.a").join(rows, ["did", "a"])
    kept = base.join(stay.hint("shuffle_hash"), ["did", "a"])
    once = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["did", "a"]))
    return once.select("whole.*")
