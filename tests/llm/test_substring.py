import random

from twinfold.llm import substring
from twinfold.llm.substring import WINDOW, difference_cover


def brute(rows):
    last = 1 << 63
    words = [((last if d is None else d), (t or "").split(" ") if t else []) for d, t in rows]
    words = [(d, [w for w in ws if w]) for d, ws in words]
    low = {}
    for d, w in words:
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            low[key] = min(low.get(key, last + 1), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if low[tuple(w[k : k + WINDOW])] < d:
                gone[k : k + WINDOW] = [True] * WINDOW
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((None if d == last else d, len(w), sum(gone), kept))
    return sorted(out, key=str)


def test_cover():
    for period in (1, 2, 7, 13, 20, 31):
        d = difference_cover(period)
        assert {(a - b) % period for a in d for b in d} == set(range(period))


def test_against_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n)]
    passages = [say(50), say(51), say(130), ["x"] * 160]
    rows = []
    for k in range(70):
        w = say(rng.randint(0, 150))
        for p in passages:
            if rng.random() < 0.4:
                cut = rng.randint(0, len(w))
                w = w[:cut] + p[rng.randint(0, 3) :] + w[cut:]
        rows.append((k, " ".join(w)))
    rows += [(300, rows[2][1]), (301, rows[2][1]), (301, rows[2][1]), (302, None), (None, rows[4][1]), (303, ""), (304, " ".join(say(30))), (304, " ".join(passages[2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as pos", "'z' as marks")
    got = substring.remove_repeats(df, ("pos",)).collect()
    assert all(r.pos == 0 for r in got)
    found = sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept.split())) for r in got), key=str)
    assert found == brute(rows)


def test_one_word_again_and_again(spark):
    """Documents of one window repeated thousands of times, across tasks."""
    rows = [(5, "x " * 4000), (3, "y z " * 900), (9, "a b " + "x " * 3000 + "c"), (2, "x " * 49), (11, "y z " * 700 + "end"), (1, "q " * 200), (12, "x " * 60 + "other " + "x " * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept.split())) for r in substring.remove_repeats(df).collect()), key=str)
    assert got == brute([(d, " ".join(t.split())) for d, t in rows])


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
