"""Media columns: PNG images in binary columns and low-frequency cosine hashes.

Encoding: 8-bit RGB rows of 192 bytes, each under the filter (none, left or up) of
least absolute sum, in zlib chunks with checksums. Decoding tests every chunk's
checksum and undoes all five PNG filters in numpy. A hash is 64 bits: the lowest
8 x 8 cosine terms of a 32 x 32 grey reduction, each against their median.

Null text is empty; an empty text is one row of blanks. Broken images raise
ValueError. Equal texts give equal values; each row is worked on alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, pick, plain, slices, text_buffers

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of one image-data chunk.
CHUNK = 1 << 16


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, channels: int = 3, level: int = 1) -> bytes:
    """pixels: height x (width * channels) bytes."""
    h, w = pixels.shape
    left, up = pixels.copy(), pixels.copy()
    left[:, channels:] -= pixels[:, :-channels]
    up[1:] -= pixels[:-1]
    each = np.stack([pixels, left, up])
    best = np.minimum(each, -each).sum(axis=2, dtype=np.int64).argmin(axis=0)
    lines = np.empty((h, w + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = each[best, np.arange(h)]
    body = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", w // channels, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    data = [chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *data, chunk(b"IEND", b"")])


def chunks(image: bytes):
    """(kind, body) of each chunk; raises if a checksum or a length is wrong."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("a chunk is cut off")
        n = struct.unpack_from(">I", image, at)[0]
        if at + 12 + n > len(image):
            raise ValueError("a chunk is cut off")
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no end chunk")


def unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """Undo row filters 0 (none), 1 (left), 2 (up), 3 (mean) and 4 (nearest of three)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    h, w = out.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    side = np.flatnonzero(kinds == 1)
    if len(side):
        rows = out[side].reshape(len(side), w // channels, channels)
        out[side] = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(len(side), w)
    y = 0
    while y < h:
        if kinds[y] == 2:
            last = y
            while last + 1 < h and kinds[last + 1] == 2:
                last += 1
            top = max(y - 1, 0)
            out[top : last + 1] = np.cumsum(out[top : last + 1], axis=0, dtype=np.uint8)
            y = last
        elif kinds[y] in (3, 4):
            above = out[y - 1].astype(np.int32) if y else np.zeros(w, np.int32)
            a, c = np.zeros(channels, np.int32), np.zeros(channels, np.int32)
            for x in range(0, w, channels):
                b = above[x : x + channels]
                if kinds[y] == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))
                a = (out[y, x : x + channels] + guess) & 255
                out[y, x : x + channels] = a
                c = b
        y += 1
    return out


def decode_png(image: bytes) -> tuple[np.ndarray, int]:
    """Rows of bytes and the number of channels of an 8-bit image without interlace."""
    head, data = None, []
    for kind, body in chunks(image):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only 8-bit grey, RGB or RGBA without interlace")
    channels = {0: 1, 2: 3, 6: 4}[head[3]]
    try:
        plain_bytes = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    w, h = head[0] * channels, head[1]
    if len(plain_bytes) != h * (w + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(plain_bytes, np.uint8).reshape(h, w + 1), channels), channels


_N = 32
_COS = np.cos(np.pi * (2 * np.arange(_N)[None, :] + 1) * np.arange(8)[:, None] / (2 * _N)).astype(np.float64)


def _edges(n: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.arange(_N) * n // _N
    return first, np.maximum((np.arange(1, _N + 1) * n + _N - 1) // _N, first + 1)


def _shrink(a: np.ndarray) -> np.ndarray:
    """Means of 32 even, maybe overlapping parts along the first axis."""
    first, last = _edges(len(a))
    total = np.zeros((len(a) + 1, *a.shape[1:]))
    np.cumsum(a, axis=0, out=total[1:])
    return (total[last] - total[first]) / (last - first).reshape(-1, *[1] * (a.ndim - 1))


def cosine_hash(pixels: np.ndarray, channels: int) -> bytes:
    """8 bytes: the low-frequency signs of a grey image."""
    h, w = pixels.shape
    grey = pixels.reshape(h, w // channels, channels)[:, :, : 3 if channels > 2 else 1].mean(axis=2)
    small = _shrink(_shrink(grey).T).T
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def pad(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def to_media(text: bytes) -> bytes:
    return encode_png(np.frombuffer(pad(text), np.uint8).reshape(-1, ROW))


def media_column(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes, the PNG and its hash, both binary."""
    names = [*keep, "n_bytes", "media", "media_hash"]

    def run(batches):
        for b in batches:
            raw, at = text_buffers(b.column(text))
            for first, last in slices(at):
                media = [to_media(raw[at[i] : at[i + 1]].tobytes()) for i in range(first, last)]
                marks = [cosine_hash(*decode_png(m)) for m in media]
                own = [pick(b.column(k)).slice(first, last - first) for k in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at[first : last + 1])), pa.array(media, pa.binary()), pa.array(marks, pa.binary())], names)

    frame = plain(docs, *dict.fromkeys([*keep, text]))
    shape = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keep)
    return frame.mapInArrow(run, f"{shape}, n_bytes long, media binary, media_hash binary")


def digest(media: bytes, mark: bytes) -> tuple:
    """What the query tells of a stored image, all from reading it back."""
    payload = decode_png(media)[0].tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), mark.hex())


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [digest(m.as_py(), k.as_py()) for m, k in zip(b.column("media"), b.column("media_hash"))]
            columns = list(zip(*rows)) if rows else [()] * 6
            own = [pick(b.column(k)).cast(pa.int64()) for k in ("doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t.type) for c, t in zip(columns, list(_DIGEST)[2:])]], schema=_DIGEST)

    stored = media_column(load(spark, sf_dir, "documents"))
    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
