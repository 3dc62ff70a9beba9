import random
import re

import numpy as np
import pytest
import xxhash

from twinfold.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    low = {}
    for (d, _), c in zip(rows, label):
        low[c] = min(low.get(c, 1 << 63), 1 << 63 if d is None else d)
    return fp, [low[c] if low[c] < 1 << 63 else None for c in label]


def corpus():
    rng = random.Random(5)
    say = lambda n: [rng.choice(["Alpha", "beta", "gamma", "ÉTÉ", "x1", "delta,", "eps"]) + str(rng.randint(0, 40)) for _ in range(n)]
    rows = []
    for k in range(40):
        w = say(rng.randint(1, 300))
        rows.append((k * 3, " ".join(w)))
        for c in range(rng.randint(0, 3)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            rows.append((1000 + k * 10 + c, "  ".join(v) + "\n"))
    return [*rows, (5000, None), (5001, ""), (5002, " \t "), (5003, "one"), (5004, "One"), (5005, "one two"), (None, "one two"), (None, "alone here today"), (6000, rows[0][1]), (6000, rows[0][1]), (7000, "ab " * 9000)]


def test_against_brute_force(spark):
    rows = corpus()
    fp, roots = slow_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as low")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((d, f, c) for (d, _), f, c in zip(rows, fp, roots)), key=str)


def test_small_tiles(spark, monkeypatch):
    """Several tiles for a count give the same links."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 2))) for b in base for _ in range(4)}
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    want = {r.fp: r.root for r in simhash.roots_of(df).collect()}
    monkeypatch.setattr(simhash, "TILE", 7)
    monkeypatch.setattr(simhash, "SUB", 3)
    assert {r.fp: r.root for r in simhash.roots_of(df).collect()} == want
    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 3:
                x, y = (int(np.uint64(v).astype(np.int64)) for v in (a, b))
                assert want[x] == want[y]


@pytest.mark.parametrize("n", [1, 2, 254, 255, 256, 1000])
def test_majority(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    bits = [(int(x) >> b) & 1 for b in range(64) for x in h]
    want = sum(1 << b for b in range(64) if 2 * sum(bits[b * n : (b + 1) * n]) > n)
    assert simhash.majority_bits(np.concatenate([h, h]), np.array([n, 0, n])).tolist() == [want, 0, want]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
