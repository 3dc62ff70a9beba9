"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, split into letter runs, and cut into byte 3-grams and 4-grams
with word ends; each is hashed to a row of an embedding table. The mean row goes
through a linear softmax. Embeddings and weights are fitted by stochastic gradient
descent in numpy on a bounded sample of labelled rows; a temperature is fitted on a part of the
sample that the descent does not see.

Rejection looks at the n-grams that the learned languages do not have: softmax alone is sure
of any text. A text's familiar share is that of its n-grams met in two texts of the sample or
more, as if PRIOR familiar ones stood before them, so that little evidence rejects nothing. The
threshold lies between what the unseen part of the sample has and what texts of each
language have in the eyes of the others, and letters in random order in the eyes of all, nearer
to the latter. Texts that mix learned languages are familiar, so they stay.

For scoring, embeddings times weights give one score row for each bucket, so a text
costs one gather for each of its n-grams. Whole texts are read.

Null text, or a text without a letter: `und`, score 0, rejected. Empty table: empty
result. No labelled row at all: every text is `und`. Equal texts, equal results. Of labels
with one score the first by name is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, held_out, load, pick, plain, slices, text_buffers, tidy

BUCKETS = 1 << 17
DIM = 16
#: Bounds of the training sample: texts of one language, and bytes in all.
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 12_000_000
#: Share of the validation texts that the threshold keeps, and of foreign ones that it rejects,
#: where it cannot have both, the first counts.
KEPT, FOREIGN = 0.999, 0.95
#: Familiar n-grams that every text is taken to have besides its own.
PRIOR = 200

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def letters(raw: np.ndarray) -> np.ndarray:
    """Lower-case bytes; all ASCII but letters becomes a space. Two-byte Latin
    capitals are lowered as well."""
    out = _LETTER[raw]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 32
    return out


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and position of each byte 3-gram and 4-gram that begins or ends in a
    word; raw has a space at both ends."""
    c = letters(raw).astype(np.uint32)
    if len(c) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    three = c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]
    blank = c == 32
    ok3 = np.flatnonzero(~blank[1:-1])
    ok4 = np.flatnonzero(~(blank[1:-2] | blank[2:-1]))
    four = three[ok4] ^ c[ok4 + 3] * np.uint32(0x9E3779B1)
    x = np.concatenate([three[ok3] * np.uint32(0x85EBCA6B), (four ^ np.uint32(0x5BD1E995)) * np.uint32(0xC2B2AE35)])
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(15)).astype(np.int64) & (BUCKETS - 1), np.concatenate([ok3, ok4])


def fit(texts: list[bytes], labels: list[str], seed: int = 7, epochs: int = 4) -> dict | None:
    """The model: score row of each bucket, bias, label names, temperature, which buckets are
    familiar, and the threshold."""
    names = sorted(set(labels))
    if not names:
        return None
    rng, y = np.random.default_rng(seed), np.array([names.index(x) for x in labels])
    bags = []
    for t in texts:
        b, _ = grams(np.frombuffer(b" " + t + b" ", np.uint8))
        bags.append(np.unique(b, return_counts=True))
    use = [i for i, b in enumerate(bags) if len(b[0])]
    check = [i for k, i in enumerate(use) if k % 5 == 4]
    train = [i for k, i in enumerate(use) if k % 5 != 4] or use
    table = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            rate = 0.8 * (1 - done / max(steps, 1))
            done += 1
            b, n = bags[i]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[b]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            # the mean's gradient, scaled as if each text had one n-gram of each bucket
            table[b] -= (rate * len(b) ** 0.5) * np.outer(share, back)
    rows = (table @ weights).astype(np.float32)
    z = np.array([(n / n.sum()) @ rows[b] + bias for b, n in (bags[i] for i in check or train)]) if use else np.zeros((0, len(names)))
    right = y[check or train] if use else np.zeros(0, int)
    met = np.zeros((len(names), BUCKETS), np.int32)
    for i in train:
        met[y[i], bags[i][0]] += 1
    mixed = [rng.permutation(letters(np.frombuffer(texts[i], np.uint8))) for i in check]
    mixed = [np.unique(grams(np.concatenate([[32], x, [32]]).astype(np.uint8))[0], return_counts=True) for x in mixed]
    every = met.sum(axis=0)
    rows[every == 0] = 0  # not learned, so they speak for no language
    known = [familiar(bags[i], every > 1) for i in check]
    foreign = [familiar(bags[i], every - met[y[i]] > 1) for i in check] + [familiar(b, every > 1) for b in mixed if len(b[0])]
    return {"rows": rows, "bias": bias, "names": names, "t": calibrate(z, right), "seen": every > 1, "reject": between(known, foreign)}


def familiar(bag: tuple[np.ndarray, np.ndarray], seen: np.ndarray) -> float:
    return float((bag[1][seen[bag[0]]].sum() + PRIOR) / (bag[1].sum() + PRIOR))


def between(known: list[float], foreign: list[float]) -> float:
    """The threshold between two lists of familiar shares, three parts of four on the way to the
    foreign ones. Where they come close or meet, the first counts: what is rejected is at least
    twice as unfamiliar as all but a few of the known texts."""
    if not known or not foreign:
        return 0.0
    low, high = float(np.quantile(known, 1 - KEPT)), float(np.quantile(foreign, FOREIGN))
    return max(0.0, min((low + 3 * high) / 4, 2 * low - 1))


def calibrate(z: np.ndarray, right: np.ndarray) -> float:
    """The temperature of least log loss, one text in as many and two counting as wrong: else a sample
    without an error would make it sure of everything."""
    if not len(z):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.01, 10, 61):
        s = z / t
        own = s[np.arange(len(s)), right]
        rest = (s.sum(1) - own) / max(1, s.shape[1] - 1)
        loss = float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - own + (own - rest) / (len(s) + 2)))
        best = min(best, (loss, float(t)))
    return best[1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def caps(sizes: dict[str, list[int]], total: int) -> dict[str, int]:
    """For each label how many bytes a text of it may give, so that all give at most `total`:
    labels share it alike, and so do the texts of a label; what short ones leave goes to
    the others."""

    def level(amounts: list[int], total: int) -> int:
        for k, n in enumerate(sorted(amounts)):
            if n * (len(amounts) - k) > total:
                return total // (len(amounts) - k)
            total -= n
        return max(amounts, default=0)

    share = level([sum(x) for x in sizes.values()], total)
    return {k: level(x, share) for k, x in sizes.items()}


def train(docs: DataFrame) -> dict | None:
    """Fit on a bounded, repeatable sample: for each language the SAMPLE_TEXTS rows of smallest
    hash, drawn at a rate from the language's count so that few texts are read. Where they
    are over SAMPLE_BYTES in all, long texts give a stretch from a place by hash."""
    labelled = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    order = F.xxhash64("doc_id", F.lit("language"))
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * SAMPLE_TEXTS / n))])
    drawn = labelled.where(F.shiftrightunsigned(order, 11) / float(1 << 53) < rate[F.col("lang")])
    rows = drawn.select("lang", F.encode("text", "utf-8").alias("raw"), order.alias("o"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("o", "raw"))
    rows = cut(rows.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_TEXTS).withColumn("n", F.octet_length("raw")), narrow=True)
    sizes: dict[str, list[int]] = {}
    for r in rows.select("lang", "n").collect():
        sizes.setdefault(r["lang"], []).append(r["n"])
    cap = F.create_map(*[F.lit(x) for k, n in caps(sizes, SAMPLE_BYTES).items() for x in (k, n)])[F.col("lang")]
    at = F.when(F.col("n") > cap, F.pmod(F.xxhash64("o"), F.col("n") - cap + 1)).otherwise(0).cast("int")
    part = rows.withColumn("part", F.substring("raw", at + 1, cap))
    got = part.orderBy("o", "lang", "raw").select("lang", "part").collect()
    return fit([bytes(r["part"]) for r in got], [r["lang"] for r in got])


def score_texts(column: pa.Array, model: dict | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted label, score, and whether the text is accepted (see the module's rejection)."""
    raw, at = text_buffers(column)
    n = len(at) - 1
    names = model["names"] if model else []
    z, count, met = np.zeros((n, max(1, len(names)))), np.zeros(n, np.int64), np.zeros(n)
    for a, b in slices(at, 1 << 18) if model else ():
        # a space after each row keeps n-grams from crossing rows
        m = b - a
        part = np.full(int(at[b] - at[a]) + m + 1, 32, np.uint8)
        row = np.repeat(np.arange(m), np.diff(at[a : b + 1]))
        part[np.arange(len(row)) + row + 1] = raw[at[a] : at[b]]
        bucket, pos = grams(part)
        starts = at[a : b + 1] - at[a] + np.arange(m + 1)
        owner = np.searchsorted(starts, pos, side="right") - 1
        count[a:b] = np.bincount(owner, minlength=m)[:m]
        met[a:b] = np.bincount(owner[model["seen"][bucket]], minlength=m)[:m]
        for k in range(len(names)):
            z[a:b, k] = np.bincount(owner, weights=model["rows"][bucket, k], minlength=m)[:m]
    has = count > 0
    text = pc.fill_null(pick(column), "")
    lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model:
        return ["und"] * n, np.zeros(n), np.zeros(n, bool)
    mean = np.where(has[:, None], z / np.maximum(count, 1)[:, None], 0) + model["bias"]
    p = softmax(mean / model["t"])
    top = p.argmax(1)
    score = np.where(lettered, p.max(1), 0.0)
    pred = [names[t] if x else "und" for t, x in zip(top, lettered)]
    return pred, score, lettered & ((met + PRIOR) / (count + PRIOR) >= model["reject"])


def identify(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score and accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches):
        for b in batches:
            pred, score, accepted = score_texts(b.column("text"), held.value)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                [*keep, "lang_pred", "score", "accepted"],
            )

    frame = plain(docs, *dict.fromkeys([*keep, "text"]))
    shape = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keep)
    return frame.mapInArrow(tidy(run), f"{shape}, lang_pred string, score double, accepted boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    got = identify(docs, train(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
