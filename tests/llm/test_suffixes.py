import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from twinfold.llm import suffixes


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as did", "1 as rest")
    got = suffixes.remove_repeated_bytes(df).collect()
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str)
    assert found == brute(rows, suffixes.LENGTH)


def test_against_brute_force(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passages = [say(60), say(120), "z" * 450]
    rows = []
    for k in range(60):
        t = say(rng.randint(1, 200))
        for p in passages:
            if rng.random() < 0.4:
                cut = rng.randint(0, len(t))
                t = t[:cut] + p[rng.randint(0, 40) :] + t[cut:]
        rows.append((k, t))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, None), (None, rows[5][1] + "!"), (103, ""), (104, "b" * 5000), (105, "é" * 99), (106, "é" * 99), (107, "é" * 100), (108, "é" * 100 + "x")]
    near = say(300)
    rows += [(200 + k, near[: 50 * k] + "#" + near[50 * k :]) for k in range(12)]
    check(spark, rows)


def test_one_id_with_several_texts(spark):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    shared = say(120)
    check(spark, [(None, say(900) + shared + say(300)), (None, say(2000)), (1, say(50) + shared), (None, say(60)), (7, say(400) + shared), (7, say(1500)), (7, say(20))])


def test_empty(spark):
    assert suffixes.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("portion", [None, 1, 50])
@pytest.mark.parametrize("depth", [8, 9, 16, 23, 40, 200])
def test_bucket_pointers(depth, portion):
    rng = np.random.default_rng(depth)
    text = np.concatenate([rng.integers(97, 99, 300), np.full(60, 97), rng.integers(97, 100, 200)]).astype(np.uint8)
    text = np.concatenate([text, text[100:320], np.full(250, 97), text[100:320]]).astype(np.uint8)
    pointer = suffixes.bucket_pointers(text, depth, portion=portion)
    n, raw = len(text) - depth + 1, text.tobytes()
    grams = [raw[k : k + depth] for k in range(n)]
    order = sorted(grams)
    for k in range(n):
        for j in range(k):
            assert (pointer[k] == pointer[j]) == (grams[k] == grams[j])
    by_pointer = [grams[k] for k in np.argsort(pointer[:n], kind="stable")]
    assert by_pointer == order
