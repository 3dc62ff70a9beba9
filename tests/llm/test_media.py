import hashlib
import struct
import zlib

import numpy as np
import pytest

from twinfold.llm import media


def paint(rows, kinds, channels):
    """A slow encoder with given filters."""
    h, w = rows.shape
    out = bytearray()
    for y in range(h):
        out.append(kinds[y])
        for x in range(w):
            a = int(rows[y, x - channels]) if x >= channels else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - channels]) if y and x >= channels else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, near][kinds[y]]) & 255)
    head = struct.pack(">IIBBBBB", w // channels, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"tEXt", b"k\0v") + media.chunk(b"IDAT", zlib.compress(bytes(out))) + media.chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_all_filters(channels):
    rng = np.random.default_rng(channels)
    for _ in range(6):
        rows = rng.integers(0, 256, (9, 8 * channels)).astype(np.uint8)
        got, c = media.decode_png(paint(rows, rng.integers(0, 5, 9).tolist(), channels))
        assert c == channels and (got == rows).all()


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 300_000])
def test_round_trip(n):
    text = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    image = media.to_media(text)
    rows, channels = media.decode_png(image)
    assert rows.tobytes() == media.pad(text) and len(media.pad(text)) % 192 == 0 and len(media.pad(text)) >= 192
    assert len(media.cosine_hash(rows, channels)) == 8


def test_damage():
    image = bytearray(media.to_media(b"hello" * 200))
    for at in (3, 20, 45, len(image) - 6):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    for n in (0, 8, 30, len(image) - 1):
        with pytest.raises(ValueError):
            media.decode_png(bytes(image[:n]))


def test_hash_is_stable_under_brightness():
    rng = np.random.default_rng(4)
    base = np.cumsum(rng.normal(size=(64, 64)), axis=1)
    grey = (100 + 60 * (base - base.min()) / np.ptp(base)).astype(np.uint8)
    a, b = (int.from_bytes(media.cosine_hash(x, 1), "big") for x in (grey, grey + 20))
    assert bin(a ^ b).count("1") <= 2


def test_query_columns(spark):
    rows = [(1, "abc"), (2, None), (3, "abc"), (None, "é" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as media")
    got = {r.doc_id: r for r in media.media_column(df).collect()}
    assert got[1].media == got[3].media and got[2].n_bytes == 0 and got[None].n_bytes == 800
    size, sha, tail, stored, own, feature = media.digest(bytes(got[1].media), bytes(got[1].media_hash))
    assert (size, tail, stored) == (192, zlib.crc32(b" " * 16), len(got[1].media)) and sha == hashlib.sha256(b"abc".ljust(192)).hexdigest() and len(feature) == 16
    assert media.media_column(df.limit(0)).count() == 0
