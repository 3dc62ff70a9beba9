"""Substring dedup by difference-cover anchors.

Words are `[^\\x20\\x09-\\x0D]+`. Of a window of WINDOW words that also stands in a
document with a smaller doc_id, every word goes; windows are judged on the input.

Anchors are hashes of GRAM words at positions whose remainder modulo PERIOD is in a
difference cover: for any two positions some shift below PERIOD brings both into the
cover, so two equal windows share an aligned anchor. Anchors that stand in two
documents are extended: the windows that hold one are hashed whole, the smallest doc_id
of each is found, and windows of larger ids are removed. A window's 128 bits come from
two hashes of each word, made independently under a key drawn for each run, so neither
chance nor a text written for the purpose makes two windows meet.

Of equal texts only the smallest doc_id takes part; the others are removed whole if
they have a window at all. Null texts have no words; a null doc_id counts as larger than
any other, and as no larger than another null. Rows with equal doc_id are one document for
each other: their windows remove nothing of one another. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import ANCHOR_SHAPE, FIRST_NULL, Anchors, copies, covered, keyed_texts, list_slices, shared_places, with_copies
from .common import BLANK, load, mix, pick, run_hashes, slices, text_buffers, tidy, word_hashes, word_spans

WINDOW, PERIOD = 50, 31
GRAM = WINDOW - PERIOD + 1


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences give all remainders modulo period."""

    def grow(own: list[int], size: int) -> list[int] | None:
        seen = {(a - b) % period for a in own for b in own}
        if len(seen) == period:
            return own
        left = size - len(own)
        if not left or len(seen) + sum(2 * (len(own) + k) for k in range(left)) < period:
            return None
        for x in range(own[-1] + 1, period):
            if got := grow([*own, x], size):
                return got
        return None

    for size in range(1, period + 1):
        if got := grow([0], size):
            return tuple(got)
    raise ValueError(period)


def cover_positions(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions (word numbers in the slice) and the row of each."""
    n = np.diff(before)
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(row)) - before[:-1][row]
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(difference_cover(PERIOD))] = True
    # a document without a whole window has none
    p = np.flatnonzero(in_cover[inner % PERIOD] & (inner + GRAM <= n[row]) & (n[row] >= WINDOW))
    return p, row[p]


def _anchor_batches(key: int):
    def run(batches):
        gathered = Anchors(by_doc=True)
        for b in batches:
            raw, at = text_buffers(b.column("text"))
            did = pick(b.column("did")).to_numpy()
            for first, last in slices(at):
                part = raw[at[first] : at[last]]
                starts, ends, before = word_spans(part, BLANK, at[first : last + 1] - at[first])
                p, row = cover_positions(before)
                if len(p):
                    h = run_hashes(word_hashes(part, starts, ends, key), GRAM)
                    yield from gathered.add(h[p], did[first + row], p - before[row])
        yield from gathered.flush()

    return run


_WINDOW_SHAPE = "k1 long, k2 long, m boolean, did long, pos int, more binary"
_WINDOWS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("m", pa.bool_()), ("did", pa.int64()), ("pos", pa.int32()), ("more", pa.binary())])


def _combine_windows(held):
    """Windows of a larger did than the smallest here are removed at once; they
    carry their hash as k2. The others go on to be compared, those that one document has
    several times as one row: `more` holds the hash and the other places."""
    h1, h2, did, pos = (np.concatenate(x) for x in zip(*held))
    o = np.lexsort((pos, did, h2, h1))
    h1, h2, did, pos = h1[o], h2[o], did[o], pos[o]
    first = np.ones(len(h1), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    low = did[np.flatnonzero(first)][np.cumsum(first) - 1]
    m = np.minimum(did, FIRST_NULL) > low
    again = np.zeros(len(m), bool)
    again[1:] = ~m[1:] & ~first[1:] & (did[1:] == did[:-1])
    more: dict[int, bytes] = {}
    if again.any():
        edge = np.diff(np.concatenate([[0], again.view(np.int8), [0]]))
        for a, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            more[a - 1] = h1[a : a + 1].tobytes() + pos[a:e].astype(np.int32).tobytes()
    k1 = np.where(m, mix(did.view(np.uint64)), h1).view(np.int64)
    k2 = np.where(m, h1, h2).view(np.int64)
    rows = np.flatnonzero(~again)
    for i in range(0, len(rows), 200_000):
        s = rows[i : i + 200_000]
        others = pa.array([more.get(x) for x in s.tolist()] if more else [None] * len(s), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(k1[s]), pa.array(k2[s]), pa.array(m[s]), pa.array(did[s]), pa.array(pos[s].astype(np.int32)), others], schema=_WINDOWS)


def _window_batches(key: int):
    def run(batches):
        held, n = [], 0
        for b in batches:
            raw, at = text_buffers(b.column("text"))
            did = pick(b.column("did")).to_numpy()
            marks, bound = list_slices(b.column("marks"))
            for first, last in slices(at):
                if bound[last] == bound[first]:
                    continue
                part = raw[at[first] : at[last]]
                starts, ends, before = word_spans(part, BLANK, at[first : last + 1] - at[first])
                row = np.repeat(np.arange(last - first), np.diff(bound[first : last + 1]))
                p = marks[bound[first] : bound[last]].astype(np.int64)
                most = np.diff(before)[row]
                lo, hi = np.maximum(p - (PERIOD - 1), 0), np.minimum(p, most - WINDOW) + 1
                ok = lo < hi
                base = before[row]
                s = np.flatnonzero(covered(len(starts), (lo + base)[ok], (hi + base)[ok]))
                if len(s):
                    owner = np.searchsorted(before, s, side="right") - 1
                    h1, h2 = (run_hashes(word_hashes(part, starts, ends, k), WINDOW)[s] for k in (key, ~key))
                    held.append((h1, h2, did[first + owner], s - before[owner]))
                    n += len(s)
                if n >= 1_000_000:
                    yield from _combine_windows(held)
                    held, n = [], 0
        if held:
            yield from _combine_windows(held)

    return run


def _result_batches(make, key: int):
    """The last pass over the texts; make gives the last column from the kept words. Places come
    by did, which rows may share: each counts where the row has the window's hash (its
    first half, enough to tell a few rows apart)."""

    def run(batches):
        for b in batches:
            raw, at = text_buffers(b.column("text"))
            copy = pick(b.column("copy")).to_numpy(zero_copy_only=False)
            pos, bound = list_slices(b.column("pos"))
            seen, _ = list_slices(b.column("h"))
            others = b.column("more").to_pylist()
            n_words, n_removed, out = [], [], []
            for first, last in slices(at):
                part = raw[at[first] : at[last]]
                starts, ends, before = word_spans(part, BLANK, at[first : last + 1] - at[first])
                some = bound[last] > bound[first]
                h = run_hashes(word_hashes(part, starts, ends, key), WINDOW) if some else ()
                for i in range(last - first):
                    a, e = int(before[i]), int(before[i + 1])
                    n, p = e - a, pos[bound[first + i] : bound[first + i + 1]].astype(np.int64)
                    gone = np.zeros(n, bool)
                    if copy[first + i]:
                        gone[:] = n >= WINDOW
                    elif len(p):
                        own = seen[bound[first + i] : bound[first + i + 1]].view(np.uint64)
                        for x in others[first + i] or ():
                            p = np.append(p, np.frombuffer(x, np.int32, offset=8))
                            own = np.append(own, np.repeat(np.frombuffer(x, np.uint64, 1), len(p) - len(own)))
                        p, own = p[p + WINDOW <= n], own[p + WINDOW <= n]
                        p = p[h[a + p] == own]
                        gone = covered(n, p, p + WINDOW)
                    text = raw[at[first + i] : at[first + i + 1]].tobytes()
                    words = text.split()
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                    out.append(make(text, kept, n_removed[-1]))
            yield pa.RecordBatch.from_arrays([pick(b.column("rest")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["rest", "n_words", "n_removed", "out"])

    return run


def _dedup(docs: DataFrame, make, out: str, rest: tuple[str, ...] = ()) -> DataFrame:
    key = secrets.randbits(64)
    base = keyed_texts(docs, rest)
    texts = with_copies(base, copies(base))
    own = ["did", "text", "rest"]
    anchors = texts.where("not copy").select(*own).mapInArrow(tidy(_anchor_batches(key)), ANCHOR_SHAPE)
    marks = shared_places(anchors, by_doc=True)
    joined = texts.join(marks.hint("shuffle_hash"), "did").where("not copy").select(*own, "marks")
    windows = joined.mapInArrow(tidy(_window_batches(key)), _WINDOW_SHAPE)
    low = F.min("did").over(Window.partitionBy("m", "k1", "k2"))
    gone = windows.withColumn("low", low).where(F.col("m") | (F.least("did", F.lit(FIRST_NULL)) > F.col("low")))
    gone = gone.groupBy("did").agg(F.collect_list("pos").alias("pos"), F.collect_list(F.expr("if(m, k2, k1)")).alias("h"), F.collect_list("more").alias("more"))
    last = texts.join(gone.hint("shuffle_hash"), "did", "left").select(*own, "copy", "pos", "h", "more")
    shape = f"rest {base.schema['rest'].dataType.simpleString()}, n_words long, n_removed long, out string"
    done = last.mapInArrow(tidy(_result_batches(make, key)), shape)
    return done.select("rest.*", "n_words", "n_removed", F.col("out").alias(out))


def remove_repeats(docs: DataFrame, rest: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in rest, n_words, n_removed and `kept`: the remaining words
    joined by spaces where words went, else the text as it was."""
    return _dedup(docs, lambda text, kept, gone: (b" ".join(kept) if gone else text).decode(), "kept", rest)


def op6_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda text, kept, gone: hashlib.sha256(b" ".join(kept)).hexdigest()
    return _dedup(load(spark, sf_dir, "documents"), sha, "kept_sha256")
