import random
import re

import pytest

from twinfold.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for key, text in items:
            x = words(text)
            n = min(10, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(key))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def make():
    rng = random.Random(6)
    say = lambda n: [rng.choice(["Aa", "b", "cé", "d2", "EE", "f"]) + rng.choice("xyz") for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(1, 40)))) for k in range(25)] + [(30, None), (31, "..."), (32, "solo"), (33, "Solo!"), (34, "a a a a a a a a a a a a")]
    items.append((35, items[20][1]))
    rows = []
    for k in range(80):
        w = say(rng.randint(0, 60))
        for key, t in rng.sample(items, 4):
            if t and rng.random() < 0.5:
                x = re.split(r"\s+", t)
                a = rng.randint(0, max(0, len(x) - 9))
                w += ["|", *[v.upper() + "," for v in x[a : a + rng.randint(8, 14)]]]
        rows.append((k, " ".join(w)))
    return [*rows, (90, None), (91, ""), (92, "SOLO"), (92, "SOLO"), (None, "x solo y"), (93, "a " * 3000)], items


@pytest.mark.parametrize("block", [4_000_000, 400])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    rows, items = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as spans")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as doc_id")
    got = decontaminate.hit_spans(docs, bench).collect()
    found = sorted(((r.row.doc_id, r.n_words, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])), sorted(r["items"])) for r in got), key=str)
    assert found == brute(rows, items)


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_clashing_names(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    names = ("items", "spans", "n_words", "row", "a", "b", "key", "block", "text_key", "copies")
    docs = spark.createDataFrame([(1, "solo here"), (2, None)], "doc_id long, text string").selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["solo", "duo", "solo", "x y z " * 20])], "item_id long, text string")
    got = {r.row.doc_id: r for r in decontaminate.hit_spans(docs, bench, ("doc_id", "text", *names)).collect()}
    assert got[1].spans == [0, 1] and got[1]["items"] == ["0", "2"] and got[2].spans == [] and got[2].n_words == 0
    assert all(got[d].row[c] == f"{c}{d}" for d in (1, 2) for c in names) and got[1].row.text == "solo here"


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.spans for r in decontaminate.hit_spans(docs, none).collect()] == [[]]
    assert decontaminate.hit_spans(docs.limit(0), none).count() == 0
