"""SimHash near-dedup: 64-bit fingerprints of 3-word shingles, and a tiled exact
comparison of all distinct fingerprints.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A bit of the fingerprint is 1 if
more than half of the shingles' XXH64 values (seed 42) have it. Texts of one or two
words are one shingle; texts without words have fingerprint zero and are linked like
any other. Fingerprints link at RADIUS or fewer differing bits; linked documents
form components, named by their smallest doc_id.

Comparison: distinct fingerprints are dealt into tiles of one population count (a
frequent count has several tiles, by hash). Tiles whose counts differ by more than the
radius are never paired; within a pair, sub-tiles sorted by the population counts of
their bytes are skipped by the same bound. The rest is compared with exclusive-or and
bit counts. A pair of tiles gives stars of its components, not all links, so a large
group of near copies gives few rows.

Null text has no words. A null doc_id counts as the largest; equal rows fall together.

What the tiles need (sides, blocks, pairs of tiles) also serves neardup, whose fingerprints
are wider and whose links are checked against the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, components, cut, load, pick, plain, tidy

RADIUS = 3
SEED = 42
#: Fingerprints of a tile, about, and of a sub-tile.
TILE, SUB = 131_072, 256
#: Bytes of a tile that carries more than fingerprints.
TILE_BYTES = 16_000_000


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of each 3-word shingle; of the whole sequence where there are fewer words."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= 3:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-3] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], SEED) for s, e in zip(starts, ends[2:].tolist())]


_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of `sizes` hashes; an empty run gives zero.
    Eight bit columns are added at a time, in byte lanes of blocks of at most 255."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    blocks = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(len(n)), blocks)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = first[owner] + inner * 255
    heads = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    for s in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(s)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        for lane in range(8):  # little-endian: lane k holds bit 8k + s
            out[full] |= (counts[:, lane] * 2 > n).astype(np.uint64) << np.uint64(8 * lane + s)
    return out


def fingerprint_column(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    held, sizes, first, n = [], [], 0, 0
    for i, t in enumerate(texts):
        own = shingle_hashes(t or "")
        held.append(np.array(own, np.uint64))
        sizes.append(len(own))
        n += len(own)
        if n > 500_000 or i + 1 == len(texts):
            out[first : i + 1] = majority_bits(np.concatenate(held), np.array(sizes))
            held, sizes, first, n = [], [], i + 1, 0
    return out


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `fp`, the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = fingerprint_column(pick(b.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*[pick(b.column(k)) for k in keep], pa.array(fp.view(np.int64))], [*keep, "fp"])

    frame = plain(docs, *dict.fromkeys([*keep, "text"]))
    shape = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keep)
    return frame.mapInArrow(tidy(run), f"{shape}, fp long")


# --- tiles ------------------------------------------------------------------------


class Forest:
    """Which numbers have been joined; asked for many of them at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            next_up = self.up[r]
            if (next_up == r).all():
                self.up[x] = r
                return r
            r = next_up

    def join(self, roots: np.ndarray) -> None:
        self.up[roots] = roots.min()

    def stars(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, smallest value of its group), where the two differ; signed."""
        label, value = self.roots(np.arange(len(self.up))), value.view(np.int64)
        o = np.lexsort((value, label))
        first = np.ones(len(o), bool)
        first[1:] = label[o][1:] != label[o][:-1]
        low = value[o][np.flatnonzero(first)][np.cumsum(first) - 1]
        return value[o][~first], low[~first]


def _byte_counts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint8)).astype(np.int8)


class Side:
    """The fingerprints of a tile, (n, lanes), in an order that keeps like ones together: by set
    size if there is one, by the population counts of their bytes. base: number of the first."""

    def __init__(self, fp: np.ndarray, base: int, size: np.ndarray | None = None):
        counts = _byte_counts(fp)
        o = np.lexsort(counts.T[::-1] if size is None else (*counts.T[::-1], size))
        self.fp, self.own, counts = fp[o], o + base, counts[o]
        self.cuts = np.arange(0, len(fp), SUB)
        reduced = lambda f, x: f.reduceat(x, self.cuts, axis=0).astype(np.int64)
        self.low, self.high = reduced(np.minimum, counts), reduced(np.maximum, counts)
        size = np.zeros(len(fp)) if size is None else size[o]
        self.least, self.most = reduced(np.minimum, size), reduced(np.maximum, size)


def near_blocks(x: Side, y: Side, radius: int, same: bool):
    """Blocks of sub-tiles that may hold links: numbers of rows and columns, and which pairs are
    within the radius. Sub-tiles are skipped if the population counts of their bytes, or their
    set sizes, are too far apart."""
    for k, s in enumerate(x.cuts):
        gap = np.maximum(0, np.maximum(x.low[k] - y.high, y.low - x.high[k])).sum(axis=1)
        fits = (gap <= radius) & (5 * x.most[k] >= 4 * y.least) & (5 * y.most >= 4 * x.least[k])
        a = x.fp[s : s + SUB]
        for j in np.flatnonzero(fits):
            if same and j < k:
                continue
            b = y.fp[y.cuts[j] : y.cuts[j] + SUB]
            d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            for lane in range(1, a.shape[1]):
                d += np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])  # at most 192 with three lanes
            near = d <= radius
            if same and j == k:
                near &= ~np.eye(len(a), len(b), dtype=bool)
            if near.any():
                yield x.own[s : s + SUB], y.own[y.cuts[j] : y.cuts[j] + SUB], near


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components that the links between two tiles (or within one) make:
    (value, smallest value of its component), signed."""
    nodes = a if same else np.concatenate([a, b])
    forest, x = Forest(len(nodes)), Side(a[:, None], 0)
    for i, j, near in near_blocks(x, x if same else Side(b[:, None], len(a)), radius, same):
        ri, rj = forest.roots(i), forest.roots(j)
        near &= ri[:, None] != rj[None, :]
        while near.any():  # of each row that still leads elsewhere its first link
            u = np.flatnonzero(near.any(axis=1))
            for p, q in zip(i[u].tolist(), j[near[u].argmax(axis=1)].tolist()):
                forest.join(forest.roots(np.array([p, q])))
            ri, rj = forest.roots(i), forest.roots(j)
            near &= ri[:, None] != rj[None, :]
    return forest.stars(nodes)


# --- tile pairs ---------------------------------------------------------------------


def dealt_pairs(rows: DataFrame, p, s, reach: int, bytes_of=None) -> DataFrame:
    """rows, each given to every pair of tiles that its own tile is part of: (x1, t1) below
    (x2, t2), or the same, and whether it stands on the left. A tile holds rows of one class:
    p, of which classes up to `reach` apart are paired, and s, of which neighbours are.
    Classes of more than TILE rows (or TILE_BYTES, by bytes_of) have several tiles, by hash."""
    wide = 1 << 10  # more than there are values of s
    base = rows.withColumn("x", (p * wide + s).cast("int"))
    size = F.sum(bytes_of if bytes_of is not None else F.lit(0)).alias("b")
    sizes = base.groupBy("x").agg(F.count(F.lit(1)).alias("n"), size).collect()  # as few as there are classes
    if not sizes:
        return base.select("*", *[F.lit(0).alias(c) for c in ("x1", "t1", "x2", "t2")], F.lit(True).alias("left"))
    parts = {r["x"]: max(1, -(-r["n"] // TILE), -(-(r["b"] or 0) // TILE_BYTES)) for r in sizes}
    table = F.create_map(*[F.lit(int(v)) for k, n in parts.items() for v in (k, n)])
    base = base.withColumn("t", F.pmod(F.xxhash64("node"), table[F.col("x")]).cast("int"))
    near = [dp * wide + ds for dp in range(-reach, reach + 1) for ds in (-1, 0, 1)]
    own = F.struct(F.col("x").alias("x"), F.col("t").alias("t"))
    met = F.flatten(F.transform(
        F.filter(F.transform(F.array(*map(F.lit, near)), lambda d: F.col("x") + d), lambda q: F.try_element_at(table, q).isNotNull()),
        lambda q: F.transform(F.sequence(F.lit(0), F.try_element_at(table, q) - 1), lambda k: F.struct(q.alias("x"), k.alias("t"))),
    ))
    pair = lambda o: F.struct(F.least(own, o).alias("u"), F.greatest(own, o).alias("v"), (own <= o).alias("left"))
    out = base.withColumn("pair", F.explode(F.transform(met, pair)))
    names = [F.col("pair.u.x").alias("x1"), F.col("pair.u.t").alias("t1"), F.col("pair.v.x").alias("x2"), F.col("pair.v.t").alias("t2")]
    return out.select(*rows.columns, *names, F.col("pair.left").alias("left"))


PAIR = ("x1", "t1", "x2", "t2")


def per_pair(run):
    """run(left table, right table or None) for the rows of a tile pair."""

    def compare(t: pa.Table) -> pa.Table:
        x1, t1, x2, t2 = (t.column(c)[0].as_py() for c in PAIR)
        if (x1, t1) == (x2, t2):
            return run(t, None)
        left = t.column("left")
        a, b = t.filter(left), t.filter(pc.invert(left))
        return run(a, b) if len(a) and len(b) else run(a.slice(0, 0), None)

    return compare


_STAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, enough to connect each component."""

    def run(x: pa.Table, y: pa.Table | None) -> pa.Table:
        a, b = (None if t is None else t.column("node").to_numpy().view(np.uint64) for t in (x, y))
        if not len(a):
            return _STAR.empty_table()
        return pa.table(tile_links(a, a if b is None else b, radius, b is None), schema=_STAR)

    dealt = dealt_pairs(distinct.select(F.col("fp").alias("node")), F.bit_count("node"), F.lit(0), radius)
    return dealt.groupBy(*PAIR).applyInArrow(per_pair(run), "a long, b long")


def roots_of(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for each distinct fingerprint of marked: root names its component."""
    classes = cut(marked.select("fp").distinct(), narrow=True)
    found = components(links(classes, radius)).withColumnRenamed("node", "fp")
    return classes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id for each row of docs."""
    marked = cut(fingerprints(docs))
    low = marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("low"))
    known = roots_of(marked, radius).join(low, "fp")
    best = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(best, "root").select("fp", F.when(F.col("component_id") < NULL_ID, F.col("component_id")).alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(load(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
