import random

import corpus_pipeline as pipeline
from twinfold.llm import neardup, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), 1 << 63), (1 << 63) - 1 if d is None else d)
    return sorted(best.values())


def test_against_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    rows, texts, common = [], [], say(40)
    for _ in range(25):
        texts.append(say(rng.randint(3, 150)) + (common if rng.random() < 0.5 else []))
    for k in range(400):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = say(1)[0]
        rows.append((k, " ".join(w) if k % 3 else "  ".join(w).upper()))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "Two one"), (904, "ONE two"), (None, rows[0][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((1 << 63) - 1 if r.doc_id is None else r.doc_id for r in neardup.keep_one(df).collect())
    assert got == brute(rows) and len(got) < 350
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_small_tiles_and_clashing_names(spark, monkeypatch):
    """Many tiles give the same rows, and columns of any name come back as they were."""
    rng = random.Random(6)
    say = lambda n: ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    texts, rows = [say(rng.randint(5, 90)) for _ in range(12)], []
    for k in range(300):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = say(1)[0]
        rows.append((k, " ".join(w)))
    names = ("did", "a", "node", "copies", "whole", "root", "n", "f0", "left")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    monkeypatch.setattr(simhash, "TILE", 9)
    monkeypatch.setattr(simhash, "TILE_BYTES", 4000)
    got = neardup.keep_one(df).collect()
    assert sorted(r.doc_id for r in got) == brute(rows)
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names) and got[0].asDict().keys() == {"doc_id", "text", *names}


def test_stage_drops_the_planted_near_copy(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows = [(k, say(60), "aa", None, 0) for k in range(40)]
    rows += [(201 + k, t + " x", "aa", None, 0) for k, (_, t, *_) in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.one_of_each(spark, docs, "").collect()) == list(range(40))
