import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinfold.llm import language, quality
from twinfold.llm.common import held_out

SYLLABLES = {"aa": ["the", "ing", "ou", "wh", "er"], "bb": ["sch", "ung", "ü", "pf", "ein"], "cc": ["ción", "ñ", "que", "os", "ar"]}


def talk(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def docs(spark, n=300):
    rng = random.Random(9)
    rows = [(k, talk(lang := "abc"[k % 3] * 2, rng.randint(3, 80), rng), lang) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out(spark):
    d = docs(spark).withColumn("score", F.lit("clash"))
    got = language.identify(d, language.train(d), ("doc_id", "lang")).where(held_out()).collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(right) > 40 and np.mean(right) > 0.95
    assert np.mean([r.accepted for r in got]) > 0.97


def test_language_edges(spark):
    d = docs(spark)
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "123 456 !"), (4, "é"), (5, "The " * 30_000), (None, "中文")], "doc_id long, text string")
    model = language.train(d)
    got = {r.doc_id: r for r in language.identify(edge, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and not got[k].accepted for k in (1, 2, 3))
    assert got[5].lang_pred == "aa" and got[4].lang_pred in SYLLABLES and got[None].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.train(d.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None and {r.lang_pred for r in language.identify(edge, nothing).collect()} == {"und"}
    assert language.identify(edge.limit(0), model).count() == 0


FOREIGN = ["これは日本語の文章です。私たちは毎日学校へ行きます。", "Это русский текст, который модель никогда не видела", "xkcd qwrtp zxcvb mnbvc lkjhg pqzxw vbnmk", "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q2Zm9vYmFyYmF6cXV4Cg"]


def test_language_rejects_what_it_has_not_learned():
    rng = random.Random(3)
    for left_out in SYLLABLES:
        langs = [k for k in SYLLABLES if k != left_out]
        texts = [talk(k, rng.randint(20, 80), rng) for k in langs for _ in range(150)]
        model = language.fit([t.encode() for t in texts], [k for k in langs for _ in range(150)])
        accepted = lambda ts: language.score_texts(pa.array(ts), model)[2].mean()  # noqa: B023, E731
        assert accepted([talk(left_out, 60, rng) for _ in range(50)]) < 0.05
        assert accepted([t * 4 for t in FOREIGN]) == 0
        assert accepted([talk(k, rng.randint(1, 80), rng) for k in langs for _ in range(100)]) > 0.99
        assert accepted([talk(langs[0], 20, rng) + " " + talk(langs[1], 20, rng) for _ in range(50)]) == 1


def test_language_against_a_plain_loop():
    """Scores of whole texts, n-gram by n-gram, from the learned tables."""
    rng = random.Random(4)
    texts = [talk(k, rng.randint(1, 40), rng) for k in SYLLABLES for _ in range(30)]
    m = language.fit([t.encode() for t in texts], [k for k in SYLLABLES for _ in range(30)])
    for t in [*texts[:20], "É a", "中文 abc", "a" * 3000, " x "]:
        bucket = language.grams(np.frombuffer(b" " + t.encode() + b" ", np.uint8))[0].tolist()
        z = [(sum(float(m["rows"][b, k]) for b in bucket) / max(1, len(bucket)) + float(m["bias"][k])) / m["t"] for k in range(3)]
        p = np.exp(np.array(z) - max(z))
        share = (sum(bool(m["seen"][b]) for b in bucket) + language.PRIOR) / (len(bucket) + language.PRIOR)
        pred, score, accepted = language.score_texts(pa.array([t]), m)
        assert pred[0] == m["names"][int(np.argmax(z))] and abs(score[0] - p.max() / p.sum()) < 1e-5
        assert bool(accepted[0]) == (share >= m["reject"])


def test_language_does_not_depend_on_neighbours():
    rng = random.Random(0)
    texts = [talk(k, rng.randint(1, 40), rng) for k in SYLLABLES for _ in range(30)]
    model = language.fit([t.encode() for t in texts], [k for k in SYLLABLES for _ in range(30)])
    alone = [language.score_texts(pa.array([t]), model)[1][0] for t in texts]
    assert np.allclose(language.score_texts(pa.array(texts), model)[1], alone)


def sampled(spark, monkeypatch, rows):
    """How many texts of each label training is given, and their bytes in all."""
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, labels: seen.append((texts, labels)))
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (texts, labels), = seen
    return {k: labels.count(k) for k in set(labels)}, sum(map(len, texts))


def test_language_sample_of_a_rare_label(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 40)
    # label g is rarer, but has more rows than are taken
    rows = [(k, f"text {k}", "abcdef"[k % 6]) for k in range(12_000)] + [(20_000 + k, f"rare {k}", "g") for k in range(200)]
    count, _ = sampled(spark, monkeypatch, rows)
    assert set(count) == set("abcdefg") and min(count.values()) >= 30 and max(count.values()) <= 40


def test_language_sample_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 40)
    monkeypatch.setattr(language, "SAMPLE_BYTES", 100_000)
    rows = [(k, f"{k:06d} " * 1300, "abc"[k % 3]) for k in range(3000)] + [(5000 + k, f"{k:06d} " * 1300, "d") for k in range(120)]
    count, held = sampled(spark, monkeypatch, rows)
    assert set(count) == set("abcd") and min(count.values()) >= 30 and 60_000 < held <= 100_000


def test_language_caps():
    assert language.caps({"a": [5, 5], "b": [100, 20]}, 60) == {"a": 5, "b": 30}
    assert language.caps({"a": [5], "b": [7, 8]}, 60) == {"a": 5, "b": 8}
    assert language.caps({"a": [10] * 3, "b": [10]}, 20) == {"a": 3, "b": 10}


def test_quality_learns_junk_passages(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(500):
        text, bad = talk("aa", rng.randint(5, 400), rng), rng.random() < 0.3
        if bad:  # junk in a part of the text only
            w = text.split(" ")
            a = rng.randrange(len(w))
            w[a : a + 60] = [x + rng.choice(["###", "$$$", "***"]) for x in w[a : a + 60]]
            text = " ".join(w)
        rows.append((k, text))
        labels.append((k, int(not bad), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit(1))
    lab = spark.createDataFrame([*labels, (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, lab)
    truth = {k: y for k, y, _ in labels}
    got = quality.score(d, model).where(held_out()).collect()
    good = np.mean([(r.score >= 0.7) == bool(truth[r.doc_id]) for r in got])
    assert len(got) > 80 and good > 0.85


def test_quality_sample_holds_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_TEXTS", 60)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 60_000)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, bag, y: seen.append((bag, y)) or "model")
    rows = [(k, f"{k} " * (4000 if k % 2 else 10)) for k in range(600)] + [(5, "5 " * 4000)] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, quality int")
    assert quality.train(d, labels) == "model"
    (bag, y), = seen
    assert 45 <= len(y) <= 60 and 0.2 < np.mean(y) < 0.8 and 40_000 < bag[-1] * quality.PASSAGE < 90_000


def test_quality_against_a_plain_loop():
    """Scores from the learned weights, passage by passage."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)).decode() for n in (0, 1, 7, 511, 512, 513, 3000)] + [None, "é" * 700]
    x, bag = quality.encode(rng.integers(32, 127, 9000).astype(np.uint8), np.array([0, 0, 700, 4000, 9000]))
    m = quality.fit(x, bag, np.array([0, 1, 1, 0], np.float32), epochs=3)
    got, _ = quality.score_texts(pa.array(texts, pa.string()), m)
    for t, s in zip(texts, got):
        raw = (t or "").encode()
        code, weight = [], []
        for alone in quality.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]:
            h = np.tanh(alone @ m["E"] + m["e"])
            code.append(h)
            weight.append(float(np.exp((np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"])))
        assert len(code) == max(1, -(-len(raw) // quality.PASSAGE))
        z = sum(w * h for w, h in zip(weight, code)) / sum(weight)
        assert abs(1 / (1 + np.exp(-(z @ m["c"] + m["b"][0]))) - s) < 1e-4


def test_quality_edges(spark):
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 700_000), (None, "x")], "doc_id long, text string")
    assert [r.score for r in quality.score(edge, None).collect()] == [0.5] * 4
    rng = np.random.default_rng(1)
    x, bag = quality.encode(rng.integers(32, 127, 9000).astype(np.uint8), np.array([0, 0, 700, 9000]))
    assert len(x) == bag[-1] == 1 + 2 + 17
    model = quality.fit(x, bag, np.array([0, 1, 1], np.float32), epochs=2)
    got = {r.doc_id: r.score for r in quality.score(edge, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and abs(got[1] - got[2]) < 1e-9
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(edge, none) is None


def test_quality_gradients():
    rng = np.random.default_rng(3)
    x, bag, y = rng.normal(size=(7, quality.WIDTH)), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    m = {"E": rng.normal(size=(quality.WIDTH, 5)) * 0.1, "e": rng.normal(size=5), "V": rng.normal(size=(5, 4)), "U": rng.normal(size=(5, 4)), "w": rng.normal(size=4), "c": rng.normal(size=5), "b": np.zeros(1)}

    def loss():
        p = quality.forward(m, x, bag)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality.gradients(m, x, bag, y)
    for k, v in m.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        keep = v[at]
        v[at] = keep + 1e-6
        up = loss()
        v[at] = keep - 1e-6
        down = loss()
        v[at] = keep
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6, k
