"""Sizes, durations, index lists and backup cadence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary units in rising order.
UNITS = "KMGTPE"
#: Words of a backup rotation, most frequent first.
CADENCES = ("daily", "weekly", "monthly", "quarterly")
_CADENCE = r"(?i)\A((?s:.*?))\b(daily|weekly|monthly|quarterly)\b[^/]*(/(?s:.*))?\z"


def parse_size(text: str) -> int:
    """`100`, `1k`, `1.5M`, `2G`, `1T`: bytes, in binary units; '' is 0."""
    text = text.strip()
    if not text:
        return 0
    power = "kmgt".find(text[-1].lower()) + 1
    number = text[:-1].strip() if power else text
    try:
        value = float(number)
    except ValueError:
        value = -1.0
    if not 0 <= value < float("inf") or "_" in number:
        raise ValueError(f"invalid size {text!r}")
    return int(value * 1024**power)


def size_of(text: Column) -> Column:
    """parse_size as a column; null where it would raise."""
    t = F.trim(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(t, r"\A(\d+(?:\.\d*)?|\.\d+)\s*([kKmMgGtT]?)\z", 1)
    unit = F.lower(F.regexp_extract(t, r"\A(\d+(?:\.\d*)?|\.\d+)\s*([kKmMgGtT]?)\z", 2))
    scale = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    value = F.floor(number.cast("double") * F.pow(F.lit(1024.0), scale)).cast("long")
    return F.when(t == "", F.lit(0).cast("long")).when(number != "", value)


def human_size(size: Column) -> Column:
    """`N B` below 1024, else one decimal and a unit; `?` below zero."""
    out = F.when(size < 0, F.lit("?")).when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, u in enumerate(UNITS, 1):
        amount = F.format_string("%.1f", F.bround(size.cast("double") / float(1024**k), 1))
        text = F.concat(amount, F.lit(f" {u}B"))
        out = out.when(size < 1024 ** (k + 1), text) if k < len(UNITS) else out.otherwise(text)
    return out


def format_size(size: int) -> str:
    if size < 0:
        return "?"
    if size < 1024:
        return f"{size} B"
    k = min(len(UNITS), (size.bit_length() - 1) // 10)
    return f"{size / 1024**k:.1f} {UNITS[k - 1]}B"


#: Seconds of each unit of a duration.
_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str) -> float:
    """Seconds of `30d`, `12h`, `1h30m`; '' and `0` are 0 (no limit)."""
    text = text.strip()
    if text in ("", "0"):
        return 0.0
    if text.endswith("d"):
        try:
            return int(text[:-1]) * 86400.0
        except ValueError:
            raise ValueError(f"invalid duration {text!r}") from None
    if not re.fullmatch(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|ms|s|m|h))+", text):
        raise ValueError(f"invalid duration {text!r}")
    total = sum(float(n) * _SECONDS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", text))
    return -total if text[0] == "-" else total


def parse_indices(text: str, most: int) -> list[int] | None:
    """`1,3-5` as places from 0, without repeats, in the given order; None if one is not
    a number of 1 to most."""
    out: dict[int, None] = {}
    for part in filter(None, re.split(r"[,\s]+", text.strip())):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        low, high = (int(m[1]), int(m[2] or m[1])) if m else (1, 0)
        if low > high or low < 1 or high > most:
            return None
        out |= dict.fromkeys(range(low - 1, high))
    return list(out) or None


def cadence_prefix(path: Column) -> Column:
    return F.regexp_extract(path, _CADENCE, 1)


def cadence_word(path: Column) -> Column:
    """The first cadence word that stands alone in a path, in lower case; null if none."""
    return F.lower(F.nullif(F.regexp_extract(path, _CADENCE, 2), F.lit("")))


def cadence_tail(path: Column) -> Column:
    """What follows the path segment of the cadence word."""
    return F.regexp_extract(path, _CADENCE, 3)


def cadence_rank(path: Column) -> Column:
    """0 for daily to 3 for quarterly; null without a cadence word."""
    word = cadence_word(path)
    out = F.lit(None).cast("int")
    for k, w in enumerate(CADENCES):
        out = F.when(word == w, F.lit(k)).otherwise(out)
    return out


def swaps(a: Column, b: Column) -> Column:
    """Whether a pair of paths differs in the cadence segment only and a is the more
    frequent one: the kept side is the less frequent."""
    same = (cadence_prefix(a) == cadence_prefix(b)) & (cadence_tail(a) == cadence_tail(b))
    return F.coalesce(same & (cadence_rank(a) < cadence_rank(b)), F.lit(False))
