"""Every registered query from Parquet, with nulls, empty and repeated rows, a long text, ties and
columns of clashing names, against slow versions of what it is to return."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from twinfold.llm import registry, sharding
from twinfold.llm.tokens import encoder, vocabulary

import test_decontaminate
import test_sharding
import test_simhash

Q = registry.queries()


def make():
    rng = random.Random(21)
    say = lambda n: ["".join(rng.choice(["the", "ing", "ou", "wé", "Er", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    bench = [(k, " ".join(say(rng.randint(3, 30)))) for k in range(6)] + [(9, None), (10, "")]
    shared, rows = say(80), []
    for k in range(90):
        w = say(rng.randint(1, 120))
        if k % 7 == 0:
            w += shared
        if k % 9 == 0:
            w += bench[k % 6][1].split()
        rows.append((k, " ".join(w)))
    rows += [(200, rows[7][1]), (201, rows[7][1] + " more"), (202, ""), (203, None), (204, "123 !"), (205, "aé " * 60_000)]
    rows += [(206, "same row " * 40)] * 3 + [(None, rows[14][1]), (None, "of its own " * 50), (207, rows[21][1]), (207, "another text of this id")]
    return rows, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, bench = make()
    names = ("did", "a", "k", "m", "pos", "fp", "rest", "row", "score", "shard", "slot", "start", "items", "n_words")
    docs = [(d, t, "ab"[i % 2] * 2, f"src{i % 3}", len(t or "")) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'{c}' as `{c}`" for c in names])
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as doc_id").write.parquet(f"{at}/benchmark.parquet")
    labels = [(d, int(d % 4 > 0), 0) for d, _ in rows if d is not None and d < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def run(spark, folder, n):
    name = next(k for k in Q if k.startswith(f"op{n}_"))
    return Q[name](spark, folder).collect()


def same(got, want, *columns):
    assert sorted((str(tuple(r[c] for c in columns)) for r in got)) == sorted(str(tuple(w)) for w in want)


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 4 == 2


def test_op1(spark, folder):
    from collections import Counter

    texts = [(d, (t or "").encode()) for d, t in make()[0]]
    count = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    want = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((d, len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    same(run(spark, folder, 1), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_op2(spark, folder):
    got = run(spark, folder, 2)
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", test_sharding.brute("" if d is None else str(d), [1.0] * 41, 40)) for d, t in make()[0]]
    same(got, want, "doc_id", "size", "text_crc32", "law", "shard")
    for k in range(sharding.SHARDS):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r.grown_shard in (r.shard, 40) for r in got)


def test_op3(spark, folder):
    got = run(spark, folder, 3)
    same(got, [(d, held(d)) for d, _ in make()[0]], "doc_id", "held_out")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert by_id[206] == by_id[206] and len(by_id[206]) == 1 and by_id[200] == by_id[7] and by_id[202] == by_id[203]


def test_op4(spark, folder):
    rows, bench = make()
    rows = [(d, t) for d, t in rows if len(t or "") < 10_000]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in test_decontaminate.brute(rows, bench)]
    got = [r for r in run(spark, folder, 4) if r.doc_id != 205]
    same(got, want, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_op5(spark, folder):
    got = run(spark, folder, 5)
    same(got, [(d, held(d)) for d, _ in make()[0]], "doc_id", "held_out")
    blank = {202, 203, 204}
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in blank) and r.lang_pred in ("aa", "bb", "und") for r in got)


def test_op6(spark, folder):
    last, low, words = 1 << 63, {}, []
    for d, t in make()[0]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append((last if d is None else d, w))
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            low[key] = min(low.get(key, last + 1), words[-1][0])
    want = []
    for d, w in words:
        gone = np.zeros(len(w) + 1, np.int64)
        for k in range(len(w) - 49):
            if low[tuple(w[k : k + 50])] < d:
                gone[k] += 1
                gone[k + 50] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((None if d == last else d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    same(run(spark, folder, 6), want, "doc_id", "n_words", "n_removed", "kept_sha256")


def test_op7(spark, folder):
    want = []
    for d, t in make()[0]:
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = run(spark, folder, 7)
    same(got, want, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    media = {}
    for r in got:
        assert media.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op8(spark, folder):
    own = encoder(vocabulary("word_bpe_49k.json")).tokenizer
    got = sorted(run(spark, folder, 8), key=lambda r: r.start)
    ids = {}
    for d, t in make()[0]:
        ids.setdefault(d, []).append([*own.encode(t or "", add_special_tokens=False).ids, 1])
    at, order = 0, [1 << 63 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == sum(map(len, ids.values()))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    same(got, [(d, len(x), crc(x)) for d, v in ids.items() for x in v], "doc_id", "n_tokens", "ids_crc32")


def test_op9(spark, folder):
    fp, roots = test_simhash.slow_components(make()[0])
    same(run(spark, folder, 9), [(d, f"{f:016x}", c) for (d, _), f, c in zip(make()[0], fp, roots)], "doc_id", "fingerprint", "component_id")


def test_op10(spark, folder):
    own = encoder(vocabulary("byte_bpe_50k.json")).tokenizer
    ids = {}
    for d, t in make()[0]:
        ids.setdefault(d, []).append([*own.encode(t or "", add_special_tokens=False).ids, 1])
    got, filled, covered = run(spark, folder, 10), {}, {}
    for r in got:
        x = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and crc(x[r.start : r.start + r.length]) == r.ids_crc32]
        assert x and r.length >= 1
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {d: sum(map(len, v)) for d, v in ids.items()}
    assert sorted(filled) == list(range(len(filled))) and len(filled) <= -(-sum(covered.values()) // 2048) + 1
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
