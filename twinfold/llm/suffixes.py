"""Suffix-array dedup by bucket-pointer refinement.

Removed is every byte that a string of LENGTH bytes covers which also starts anywhere
else, in the same document or another; strings never cross documents, overlaps count,
and all is judged on the input.

1. Meeting. Of each LENGTH-byte string the leftmost least hash of its GRAM-byte
   substrings depends on the string alone. Anchors that stand in one place only cannot
   be part of a repeat; the stretches of text round the others are dealt by anchor
   hash, so equal strings meet in one task and in nobody else's.
2. Suffix sorting. The stretches of whole anchor groups are set one after another and
   sorted by bucket-pointer refinement: positions are put into buckets by their first
   q bytes, a bucket's pointer being its first place in the suffix array; a bucket
   of several is refined by sorting on the pointers of its members further on, as far as
   they are known to agree. New pointers are written at once, so the buckets after it in
   the same pass already use them, and one that leads into a bucket refined before takes
   over its whole depth. Starts that share LENGTH bytes are repeats.

Groups are sorted where they arise first (before the shuffle) and one stretch of
each kind goes on, so a passage of a third of all documents sends a few rows from each
task. Equal stretches are one text with a weight. Texts that occur twice are removed
whole (if long enough) and one of them takes part for the others' sake.

Null texts are empty; texts under LENGTH bytes lose nothing. Rows with equal doc_id and
text are two places. Places belong to a 64-bit hash of doc_id and text, `did` here, so
different texts of one doc_id (or of none) are apart; should two rows of different texts
ever have one hash, another seed is taken. Empty table: empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import ANCHOR_SHAPE, Anchors, copies, covered, keyed_texts, list_slices, shared_places, with_copies
from .common import _TAKE, gram_hashes, lanes_of, load, mix, pick, slices, text_buffers, tidy

LENGTH, GRAM = 200, 80
SPREAD = LENGTH - GRAM + 1
Q = 8
#: Bytes of stretches that are sorted at a time (a single group may be larger).
SORT_BYTES = 2_000_000


# --- bucket-pointer refinement -------------------------------------------------


def bucket_pointers(text: np.ndarray, depth: int, q: int = Q, portion: int | None = None) -> np.ndarray:
    """For each position a number: positions have equal numbers if their next `depth` bytes are
    equal, and numbers rise with those bytes (bytes past the end are the same as byte 0
    there; callers leave out positions less than depth from the end)."""
    n = len(text)
    lanes = lanes_of(text)
    gram = lanes[:n].byteswap() >> np.uint64(64 - 8 * q)  # the first byte weighs most
    order = np.argsort(gram)
    pointer, known, seen, doubt = np.empty(n, np.int64), np.full(n, q), np.full(n, q), np.zeros(n, np.int64)
    head, size = _heads(gram[order])
    pointer[order] = head
    pending = order[size > 1]
    while len(pending):
        parts = _portions(pending, pointer, portion or max(1 << 14, n // 8))
        pending = np.concatenate([_refine(part, pointer, known, seen, doubt, order, depth) for part in parts])
    return _of_depth(lanes, order, pointer, doubt, depth)


def _portions(member: np.ndarray, pointer: np.ndarray, size: int):
    """Members in portions of whole buckets (which stand next to each other)."""
    ends = np.append(np.flatnonzero(np.diff(pointer[member])) + 1, len(member))
    at = 0
    while at < len(member):
        end = int(ends[min(np.searchsorted(ends, at + size), len(ends) - 1)])
        yield member[at:end]
        at = end


def _refine(member: np.ndarray, pointer: np.ndarray, known: np.ndarray, seen: np.ndarray, doubt: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Splits the buckets of some members by the pointers behind what each bucket is known to
    share; writes the new pointers and places, what is known to be shared, how many bytes
    have been looked at (seen), and where more than depth of them may have been needed (doubt:
    the bytes shared there). Gives the members that may split further."""
    n = len(pointer)
    bucket, shared = pointer[member], known[member]
    ahead = member + shared
    inside = ahead < n
    ahead = np.minimum(ahead, n - 1)
    key = (bucket << np.int64(31)) | np.where(inside, pointer[ahead] + 1, 0)
    o = np.argsort(key)
    member, bucket, key, shared, ahead, inside = (x[o] for x in (member, bucket, key, shared, ahead, inside))
    old, _ = _heads(bucket)
    new, size = _heads(key)
    slot = bucket + np.arange(len(member)) - old
    order[slot] = member
    looked = shared + np.where(inside, seen[ahead], depth)
    known[member] = shared + np.where(inside, known[ahead], depth)
    seen[member], pointer[member] = looked, bucket + (new - old)
    split = np.flatnonzero((key[1:] != key[:-1]) & (bucket[1:] == bucket[:-1]) & (np.minimum(looked[1:], looked[:-1]) > depth)) + 1
    doubt[slot[split]] = shared[split]
    return member[(size > 1) & (known[member] < depth)]


def _of_depth(lanes: np.ndarray, order: np.ndarray, pointer: np.ndarray, doubt: np.ndarray, depth: int) -> np.ndarray:
    """Pointers of buckets of exactly `depth` bytes: where buckets may have been told apart by
    more, those that follow each other are compared, eight bytes at a time, as long as they agree."""
    n = len(order)
    first = pointer[order] == np.arange(n)
    left = np.flatnonzero(first & (doubt > 0))
    at = doubt[left]
    while len(left):
        a, b = (np.where(order[x] + at < n, lanes[np.minimum(order[x] + at, n)], 0) for x in (left - 1, left))
        take = _TAKE[np.clip(depth - at, 0, 8)]
        same = (a & take) == (b & take)
        left, at = left[same], at[same] + 8
        first[left[at >= depth]] = False
        left, at = left[at < depth], at[at < depth]
    heads = np.flatnonzero(first)
    out = np.empty(n, np.int64)
    out[order] = heads[np.cumsum(first) - 1]
    return out


def _heads(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted values the place of the first equal one, and how many are equal."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, len(ordered)))
    return np.repeat(heads, size), np.repeat(size, size)


def repeated_starts(texts: list[bytes], weights: list[int], depth: int) -> list[np.ndarray]:
    """For each text, which starts of depth-byte strings occur more than once in all
    texts, a text of weight w counting w times."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    pointer = bucket_pointers(text, depth)
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(texts)), np.maximum(size - depth + 1, 0))
    each = np.maximum(size - depth + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + first[row]
    own = pointer[start]
    total = np.bincount(own, weights=np.asarray(weights, np.float64)[row], minlength=1)
    hit = total[own] > 1
    return np.split(hit, np.cumsum(each)[:-1])


# --- anchors --------------------------------------------------------------------


def _sliding_least(key: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: running minima within blocks, from both ends."""
    n = len(key)
    if n < w:
        return key[:0]
    blocks = -(-n // w)
    full = np.full(blocks * w, np.uint64((1 << 64) - 1))
    full[:n] = key
    grid = full.reshape(blocks, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchor_runs(raw: np.ndarray, at: np.ndarray):
    """Runs of starts with one anchor: row, first and last start, anchor position (all
    positions from the row's beginning) and the anchor's hash."""
    h = gram_hashes(raw, GRAM)
    bits = np.uint64(32)  # the same for every slice, else equal strings might choose differently
    least = _sliding_least((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), SPREAD)
    n = len(least)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, h[:0]
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # no string begins in the last LENGTH - 1 bytes of a row, so runs of two rows never touch
    step = np.zeros(n + 1, np.int8)
    full = np.flatnonzero(np.diff(at))
    np.add.at(step, np.minimum(np.maximum(at[full + 1] - LENGTH + 1, at[full]), n), 1)
    np.add.at(step, np.minimum(at[full + 1], n), -1)
    valid = np.cumsum(step[:n], dtype=np.int8) == 0
    other = place[1:] != place[:-1]
    first, last = valid.copy(), valid.copy()
    first[1:] &= other | ~valid[:-1]
    last[:-1] &= other | ~valid[1:]
    head, tail = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(at, head, side="right") - 1
    base = at[row]
    return row, head - base, tail - base, place[head] - base, h[place[head]]


def _anchor_batches(batches):
    gathered = Anchors(by_doc=False)
    for b in batches:
        raw, at = text_buffers(b.column("text"))
        did = pick(b.column("did")).to_numpy()
        for first, last in slices(at):
            row, _, _, place, h = anchor_runs(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            yield from gathered.add(h, did[first + row], place)
    yield from gathered.flush()


# --- stretches ---------------------------------------------------------------------

_STRETCH_SHAPE = "k long, m boolean, did long, lo int, hi int, piece binary"
_STRETCH = pa.schema([("k", pa.int64()), ("m", pa.bool_()), ("did", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("piece", pa.binary())])


def spans_of(groups: list[tuple[list[bytes], list[list[tuple[int, int]]]]]) -> list[tuple[int, int, int]]:
    """groups: distinct stretches and, for each, its owners (did, offset). The repeated
    bytes of the owners as (did, lo, hi)."""
    texts = [t for g in groups for t in g[0]]
    owners = [o for g in groups for o in g[1]]
    out = []
    if not texts:
        return out
    for own, hit in zip(owners, repeated_starts(texts, [len(o) for o in owners], LENGTH)):
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            out += [(d, off + a, off + b - 1 + LENGTH) for d, off in own]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _STRETCH)], schema=_STRETCH)


def _sort_stretches(groups: dict[int, dict[bytes, list]], final: bool):
    """Spans of all groups of two or more stretches, in portions of SORT_BYTES; unless
    final also one row of each distinct stretch, to meet those of other tasks."""
    spans, portion, size = [], [], 0
    for own in groups.values():
        if len(own) > 1 or any(len(o) > 1 for o in own.values()):
            portion.append((list(own), list(own.values())))
            size += sum(map(len, own))
        if size >= SORT_BYTES:
            spans += spans_of(portion)
            portion, size = [], 0
    spans += spans_of(portion)
    rows = [(int(k), True, d, lo, hi, None) for k, (d, lo, hi) in zip(_spread(spans), spans)]
    if not final:
        rows += [(k, False, o[0][0], o[0][1], 0, t) for k, own in groups.items() for t, o in own.items()]
    for i in range(0, len(rows), 20_000):
        yield _batch(rows[i : i + 20_000])


def _spread(spans: list) -> np.ndarray:
    return mix(np.array([s[0] for s in spans], np.int64).view(np.uint64)).view(np.int64)


def _stretch_batches(batches):
    groups: dict[int, dict[bytes, list]] = {}
    held = 0
    for b in batches:
        raw, at = text_buffers(b.column("text"))
        did = pick(b.column("did")).to_numpy()
        marks, bound = list_slices(b.column("marks"))
        for first, last in slices(at):
            if bound[last] == bound[first]:
                continue
            part, own = raw[at[first] : at[last]], at[first : last + 1] - at[first]
            row, lo, hi, place, h = anchor_runs(part, own)
            marked = np.zeros(len(part), bool)
            mrow = np.repeat(np.arange(last - first), np.diff(bound[first : last + 1]))
            marked[own[mrow] + marks[bound[first] : bound[last]]] = True
            use = np.flatnonzero(marked[own[row] + place])
            text = part.tobytes()
            for i, k in zip(use.tolist(), h[use].view(np.int64).tolist()):
                r, a = int(row[i]), int(lo[i])
                piece = text[own[r] + a : own[r] + int(hi[i]) + LENGTH]
                group = groups.setdefault(k, {})
                if piece not in group:
                    held += len(piece)
                group.setdefault(piece, []).append((int(did[first + r]), a))
            if held >= 24_000_000:
                yield from _sort_stretches(groups, False)
                groups, held = {}, 0
    yield from _sort_stretches(groups, False)


def _meeting_batches(batches):
    """Rows come sorted by (m, k): whole groups are sorted together, marked rows pass."""
    groups: dict[int, dict[bytes, list]] = {}
    held = 0
    for b in batches:
        m = pick(b.column("m"))
        passed = b.filter(m)
        if passed.num_rows:
            yield pa.RecordBatch.from_arrays([passed.column(c) for c in _STRETCH.names], schema=_STRETCH)
        rest = b.filter(pc.invert(m))
        keys = rest.column("k").to_pylist()
        for k, d, lo, piece in zip(keys, rest.column("did").to_pylist(), rest.column("lo").to_pylist(), rest.column("piece").to_pylist()):
            if held >= SORT_BYTES and k not in groups:
                yield from _sort_stretches(groups, True)
                groups, held = {}, 0
            group = groups.setdefault(k, {})
            if piece not in group:
                held += len(piece)
            group.setdefault(piece, []).append((d, lo))
    yield from _sort_stretches(groups, True)


# --- the operator ------------------------------------------------------------------


def _result_batches(make):
    def run(batches):
        for b in batches:
            raw, at = text_buffers(b.column("text"))
            multi = pick(b.column("multi")).to_numpy(zero_copy_only=False)
            lo, bound = list_slices(b.column("lo"))
            hi, _ = list_slices(b.column("hi"))
            removed, runs, out = [], [], []
            for i in range(b.num_rows):
                own = raw[at[i] : at[i + 1]]
                gone = np.zeros(len(own), bool)
                s = slice(bound[i], bound[i + 1])
                if multi[i]:
                    gone[:] = len(own) >= LENGTH
                elif s.start < s.stop:
                    gone = covered(len(own), lo[s].astype(np.int64), hi[s].astype(np.int64))
                removed.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                out.append(make(own[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([pick(b.column("rest")), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(out)], ["rest", "n_bytes", "n_removed", "n_spans", "out"])

    return run


def _by_row(base: DataFrame) -> DataFrame:
    """base with `did` as a hash of id and text that no two different texts share."""
    seed = 0
    while True:
        named = base.withColumn("did", F.xxhash64(F.lit(seed), "did", "text"))
        texts = named.select("did", F.xxhash64(F.lit(-1), "text").alias("b")).groupBy("did").agg(F.min("b").alias("x"), F.max("b").alias("y"))
        if texts.where("x <> y").isEmpty():
            return named
        seed += 1


def _dedup(docs: DataFrame, make, kind: str, out: str, rest: tuple[str, ...] = ()) -> DataFrame:
    base = _by_row(keyed_texts(docs, rest))
    texts = with_copies(base, copies(base))
    own = ["did", "text", "rest"]
    anchors = texts.where("not copy").select(*own).mapInArrow(tidy(_anchor_batches), ANCHOR_SHAPE)
    marks = shared_places(anchors, by_doc=False)
    joined = texts.join(marks.hint("shuffle_hash"), "did").where("not copy").select(*own, "marks")
    stretches = joined.mapInArrow(tidy(_stretch_batches), _STRETCH_SHAPE)
    met = stretches.repartition("m", "k").sortWithinPartitions("m", "k").mapInArrow(tidy(_meeting_batches), _STRETCH_SHAPE)
    spans = met.groupBy("did").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    last = texts.join(spans.hint("shuffle_hash"), "did", "left").select(*own, "multi", "lo", "hi")
    shape = f"rest {base.schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, out {kind}"
    done = last.mapInArrow(tidy(_result_batches(make)), shape)
    return done.select("rest.*", "n_bytes", "n_removed", "n_spans", F.col("out").alias(out))


def remove_repeated_bytes(docs: DataFrame, rest: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in rest, n_bytes, n_removed, n_spans and `kept`: the
    remaining bytes (binary: a removed run may end within a character)."""
    return _dedup(docs, lambda kept: kept, "binary", "kept", rest)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda kept: hashlib.sha256(kept).hexdigest()
    return _dedup(load(spark, sf_dir, "documents"), sha, "string", "kept_sha256")
