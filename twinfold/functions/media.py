"""Media facts from the JSON of a probing program, and dimensions from image headers."""

from __future__ import annotations

import json
import shutil
import struct
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sidecars import MEDIA

_STREAM = "struct<codec_type: string, codec_name: string, width: int, height: int, duration: string, avg_frame_rate: string, tags: map<string, string>>"
PROBE = f"struct<streams: array<{_STREAM}>, format: struct<duration: string, format_name: string, tags: map<string, string>>>"
#: Tags that hold a capture time, in order of preference.
TIME_TAGS = ("creation_time", "DateTimeOriginal", "com.apple.quicktime.creationdate")


def first_tag(tags: Column) -> Column:
    """The first of TIME_TAGS that is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(tags, F.lit(t)), F.lit("")) for t in TIME_TAGS])


def seconds(text: Column) -> Column:
    """A positive number of seconds, else null."""
    value = text.try_cast("double")
    return F.when(value > 0, value)


def media_facts(probe: Column) -> Column:
    """Struct of facts, null if there are none: dimensions, codec and rate of the first video or
    image stream with a width; time of the first such stream with a tag, then of the container;
    duration of the container, then of the first stream that has one."""
    p = F.from_json(probe, PROBE)
    streams = F.coalesce(p["streams"], F.array().cast(f"array<{_STREAM}>"))
    seen = F.filter(streams, lambda s: s["codec_type"].isin("video", "image"))
    main = F.get(F.filter(seen, lambda s: s["width"] > 0), F.lit(0))
    times = F.filter(F.transform(seen, lambda s: first_tag(s["tags"])), lambda t: t.isNotNull())
    lengths = F.filter(F.transform(streams, lambda s: seconds(s["duration"])), lambda d: d.isNotNull())
    rate = main["avg_frame_rate"]
    fields = {
        "width": main["width"],
        "height": main["height"],
        "duration_sec": F.coalesce(seconds(p["format"]["duration"]), F.get(lengths, F.lit(0))),
        "capture_time": F.coalesce(F.get(times, F.lit(0)), first_tag(p["format"]["tags"])),
        "codec": F.nullif(main["codec_name"], F.lit("")),
        "frame_rate": F.when((rate != "") & (rate != "0/0"), rate),
        "format_name": F.nullif(p["format"]["format_name"], F.lit("")),
    }
    some = F.coalesce(*[c.cast("string") for c in fields.values()]).isNotNull()
    return F.when(some, F.struct(*[c.alias(k) for k, c in fields.items()]).cast(MEDIA))


def image_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the beginning of a PNG, GIF or JPEG."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        kind = head[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in range(0xC0, 0xC4) or kind in range(0xC5, 0xC8) or kind in range(0xC9, 0xCC) or kind in range(0xCD, 0xD0):
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        elif kind == 0x01 or kind in range(0xD0, 0xD9):
            at += 2
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def probe(path: str, program: str | None = None) -> str | None:
    """The JSON of the probing program if it is installed, else of the image's dimensions."""
    program = program or shutil.which("ffprobe")
    if program:
        got = subprocess.run([program, "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, text=True)
        if got.returncode == 0 and (json.loads(got.stdout or "{}").get("streams")):
            return got.stdout
    try:
        with open(path, "rb") as f:
            size = image_size(f.read(1 << 18))
    except OSError:
        return None
    return json.dumps({"streams": [{"codec_type": "image", "width": size[0], "height": size[1]}]}) if size else None


def probed(files: DataFrame, *keep: str) -> DataFrame:
    """path, other columns and media facts (null where there are none) of files that executors see."""
    names = ["path", *keep]

    def run(batches):
        for b in batches:
            found = [probe(p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(found, pa.string())], [*names, "probe"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*names).schema)
    facts = F.when(F.col("probe").isNotNull(), media_facts(F.col("probe")))
    return files.select(*names).mapInArrow(run, f"{shape}, probe string").select(*names, facts.alias("media"))
