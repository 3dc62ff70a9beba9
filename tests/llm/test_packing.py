import zlib

import numpy as np
import pytest

from twinfold.llm import packing
from twinfold.llm.tokens import encoder, vocabulary


@pytest.mark.parametrize("n,k", [(1, 1), (5, 2), (40, 7), (200, 33), (9, 20)])
def test_differencing(n, k):
    sizes = np.random.default_rng(n).integers(1, 2000, n)
    window = packing.differencing(sizes, k)
    fill = np.bincount(window, weights=sizes, minlength=k)
    assert window.min() >= 0 and window.max() < k and fill.sum() == sizes.sum()
    if n >= 5 * k:
        assert np.ptp(fill) < sizes.max()


def test_known_partition():
    fill = np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(fill.tolist()) == [14, 16]


def test_window_count_rises():
    window, offset, k = packing.pack(np.array([6, 6, 6]), capacity=10)
    assert k == 3 and sorted(window.tolist()) == [0, 1, 2] and not offset.any()
    assert packing.pack(np.zeros(0, np.int64))[2] == 0
    with pytest.raises(ValueError):
        packing.pack(np.array([11]), capacity=10)


def test_padding_is_small():
    rng = np.random.default_rng(0)
    sizes = np.concatenate([rng.integers(1, 2048, 700), rng.integers(16, 128, 300)])
    assert 1 - sizes.sum() / (2048 * packing.pack(sizes)[2]) < 0.02


@pytest.mark.parametrize("n,size", [(1024, 2), (1000, 4), (600, 5), (1024, 20), (100_000, 1), (60_000, 7), (9000, 128)])
def test_equal_short_pieces_fill_their_windows(n, size):
    window, offset, k = packing.pack(np.full(n, size))
    fill = np.bincount(window, minlength=k) * size
    assert fill.max() <= 2048 and k <= -(-n * size // 2048) + max(1, n * size // 2048 // 50)
    assert sorted(zip(window.tolist(), offset.tolist())) == [(w, o * size) for w in range(k) for o in range(int(fill[w]) // size)]


@pytest.mark.parametrize("rows", [
    [(k, f"five words of text {k}") for k in range(10_000)],
    [(k, f"a few words {k % 7}") for k in range(3000)] + [(None, None)] * 6000,
])
def test_short_texts_are_packed_tightly(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_pieces(packing.pieces(df, vocabulary("byte_bpe_50k.json"))).selectExpr("sum(length) as n", "max(sequence_id) + 1 as k").first()
    assert got.k <= -(-got.n // 2048) + 1


def test_pieces_and_sequences(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(k, f"some words of text {k} " * (k * 3 % 700)) for k in range(60)] + [(100, None), (101, ""), (7, "again"), (7, "again"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as start", "0 as window")
    got = packing.pack_pieces(packing.pieces(df, path)).collect()
    own = encoder(path).tokenizer
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append([*own.encode(t or "", add_special_tokens=False).ids, 1])
    seen = {}
    for r in got:
        options = [ids for ids in texts[r.doc_id] if len(ids) == r.doc_tokens]
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in options)
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for v in texts.values() for x in v)
    assert sorted(seen) == list(range(len(seen)))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    full = packing.sequences(df, path).collect()
    assert sum(len(r.ids) for r in full) == sum(r.length for r in got) and max(len(r.ids) for r in full) <= 2048


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_pieces(packing.pieces(df, vocabulary("byte_bpe_50k.json"))).count() == 0
