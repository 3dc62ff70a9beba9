"""Quality classifier: gated-attention multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Every passage is encoded: counts of
pairs of byte classes, run-length and repetition statistics, then a learned tanh layer.
Gated attention gives each passage of a bag its weight; the weighted sum of passage
codes is the text's representation, and a logistic unit scores it. All weights are
learned from text labels alone, in numpy, with Adam, on a bounded sample.

Null and empty texts are a bag of one empty passage, so they get a score too. No
labelled row: every score is 0.5. Equal texts, equal scores. Labels of one document
given more than once count as their largest value. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, lanes_of, load, pick, plain, slices, text_buffers, tidy
from .language import caps

PASSAGE = 512
#: Bounds of the training sample: texts, and bytes in all.
SAMPLE_TEXTS = 4000
SAMPLE_BYTES = 16_000_000
PREDICT_AT = 0.7

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 end of sentence, 6 comma-like,
#: 7 bar, 8 brackets and quotes, 9 other ASCII signs, 10 control, 11 bytes above ASCII, 12 hyphen or line, 13 hash-like, 14 colon-like, 15 slash-like.
CLASSES = 16
_CLASS = np.full(256, 9, np.uint8)
for _chars, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" ", 3), (b"\n\r", 4), (b".!?", 5), (b",;", 6), (b"|", 7), (b"()[]{}<>\"'", 8), (range(0, 9), 10), (range(11, 13), 10), (range(14, 32), 10), (range(128, 256), 11), (b"-_", 12), (b"#$%&*", 13), (b":=@", 14), (b"/\\", 15)):
    _CLASS[list(_chars)] = _k
_CLASS[9] = 3
PAIRS = CLASSES * CLASSES
EXTRA = 6
WIDTH = PAIRS + EXTRA


def encode(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage (float32) and the passages before each row."""
    size = np.diff(at)
    each = np.maximum(1, -(-size // PASSAGE))
    bag = np.concatenate([[0], np.cumsum(each)])
    n = int(bag[-1])
    own = raw[at[0] : at[-1]]
    part = np.full(n, PASSAGE)
    part[bag[1:] - 1] = size - (each - 1) * PASSAGE
    passage = np.repeat(np.arange(n, dtype=np.int32), part)
    heads = (np.cumsum(part) - part)[part > 0]  # where a passage begins
    firsts = (at[:-1] - at[0])[size > 0]  # where a row begins
    kind = _CLASS[own]
    out = np.zeros((n, WIDTH), np.float32)
    length = part.astype(np.float32)
    count = lambda places: np.bincount(places, minlength=n)[:n]
    if len(own) > 1:
        key = passage[1:] * np.int32(PAIRS) + ((kind[:-1] << 4) | kind[1:])
        pairs = np.bincount(key, minlength=n * PAIRS)[: n * PAIRS]
        np.subtract.at(pairs, key[heads[heads > 0] - 1], 1)  # not of one passage
        out[:, :PAIRS] = pairs.reshape(n, PAIRS)
        equal = own[1:] == own[:-1]
        equal[heads[heads > 0] - 1] = False
        out[:, PAIRS] = count(passage[1:][equal])
    if len(own) > 8:
        # 8-grams that the passage holds more than once: repetition
        slot = (lanes_of(own)[: len(own) - 7] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int32)
        whole = np.ones(len(own), bool)  # of one text
        whole[(firsts[firsts > 0][:, None] - np.arange(1, 8)).clip(0).ravel()] = False
        whole = whole[: len(own) - 7]
        seen = np.zeros(n << 12, bool)
        seen[((passage[: len(whole)] << 12) | slot)[whole]] = True
        out[:, PAIRS + 1] = count(passage[: len(whole)][whole]) - np.count_nonzero(seen.reshape(n, 1 << 12), axis=1)
    begins = kind < 3
    begins[1:] &= kind[:-1] >= 3
    begins[firsts] = kind[firsts] < 3
    words = count(passage[begins])
    out[:, : PAIRS + 2] /= np.maximum(length, 1)[:, None]
    out[:, :PAIRS] = np.sqrt(out[:, :PAIRS])
    out[:, PAIRS + 2] = words / np.maximum(length, 1)
    out[:, PAIRS + 3] = length / PASSAGE
    total = np.repeat(size, each)
    out[:, PAIRS + 4] = np.log1p(total) / 12
    out[:, PAIRS + 5] = length == 0
    return out, bag


def _sum(x: np.ndarray, bag: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bag[:-1], axis=0)


def forward(m: dict, x: np.ndarray, bag: np.ndarray) -> dict:
    """Scores of the bags and what the backward pass needs."""
    each = np.diff(bag)
    h = np.tanh(x @ m["E"] + m["e"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    a = (t * s) @ m["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, bag[:-1]), each))
    a /= np.repeat(_sum(a, bag), each)
    z = _sum(h * a[:, None], bag)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ m["c"] + m["b"])))}


def gradients(m: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
    f, each = forward(m, x, bag), np.diff(bag)
    d = (f["p"] - y) / len(y)
    dz = np.repeat(d[:, None] * m["c"], each, axis=0)
    da = (dz * f["h"]).sum(1)
    da = f["a"] * (da - np.repeat(_sum(f["a"] * da, bag), each))
    gate = da[:, None] * m["w"]
    dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
    dh = (dz * f["a"][:, None] + dt @ m["V"].T + ds @ m["U"].T) * (1 - f["h"] ** 2)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 14, batch: int = 32, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    center, spread = x.mean(0), x.std(0) + 0.02
    x = ((x - center) / spread).astype(np.float32)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    m = {"E": draw(WIDTH, hidden) * 0.5, "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    n, step = len(y), 0
    total = epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            each = bag[rows + 1] - bag[rows]
            part = np.concatenate([[0], np.cumsum(each)])
            where = np.repeat(bag[rows] - part[:-1], each) + np.arange(part[-1])
            g = gradients(m, x[where], part, y[rows])
            step += 1
            rate = 0.004 * (1 - step / (total + 1))
            for k in m:
                grad = g[k] + (2e-4 * m[k] if k in "EVU" else 0)
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad**2 - second[k])
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    # the scaling is folded into the first layer
    m["E"] = m["E"] / spread[:, None]
    m["e"] = m["e"] - center @ m["E"]
    return {k: v.astype(np.float32) for k, v in m.items()}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """Fit on a bounded sample: of the rows that may be learned from, the SAMPLE_TEXTS of least
    hash (equal rows once). Where they are over SAMPLE_BYTES in all, the longest give a stretch
    from a place by hash, each as much as any other of them."""
    marks = labels.where(labels[label].isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = plain(docs, "doc_id", "text").where(~held_out())
    known = rows.select("doc_id").join(marks, "doc_id").count()
    if not known:
        return None
    rate = min(1.0, 1.2 * SAMPLE_TEXTS / known)
    named = rows.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    named = named.withColumn("o", F.xxhash64("doc_id", "raw", F.lit("quality"))).where(F.shiftrightunsigned("o", 11) / float(1 << 53) < rate)
    drawn = named.join(marks, "doc_id")
    sizes = sorted((r["o"], r["n"]) for r in drawn.groupBy("o").agg(F.max(F.octet_length("raw")).alias("n")).collect())[:SAMPLE_TEXTS]
    if not sizes:
        return None
    most, cap = sizes[-1][0], caps({"": [n for _, n in sizes]}, SAMPLE_BYTES)[""]
    n = F.octet_length("raw")
    at = F.when(n > cap, F.pmod(F.xxhash64("o"), n - cap + 1)).otherwise(0).cast("int")
    part = drawn.where(F.col("o") <= most).select("o", "y", F.substring("raw", at + 1, cap).alias("part"))
    got = sorted((r["o"], bytes(r["part"]), r["y"]) for r in part.groupBy("o").agg(F.max("part").alias("part"), F.max("y").alias("y")).collect())
    raws = [np.frombuffer(x, np.uint8) for _, x, _ in got]
    x = [encode(raw, np.array([0, len(raw)]))[0] for raw in raws]
    bag = np.concatenate([[0], np.cumsum([len(a) for a in x])])
    return fit(np.concatenate(x), bag, np.array([y for _, _, y in got], np.float32))


def score_texts(column: pa.Array, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and the share of its most attended passage."""
    raw, at = text_buffers(column)
    n = len(at) - 1
    score, peak = np.full(n, 0.5), np.ones(n)
    for a, b in slices(at) if model else ():
        x, bag = encode(raw, at[a : b + 1])
        f = forward(model, x, bag)
        score[a:b], peak[a:b] = f["p"], np.maximum.reduceat(f["a"], bag[:-1])
    return score, peak


def score(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score and top_attention."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for b in batches:
            s, peak = score_texts(b.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([*[pick(b.column(k)) for k in keep], pa.array(s, pa.float64()), pa.array(peak, pa.float64())], [*keep, "score", "top_attention"])

    frame = plain(docs, *dict.fromkeys([*keep, "text"]))
    shape = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keep)
    return frame.mapInArrow(tidy(run), f"{shape}, score double, top_attention double")


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    got = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "top_attention")
