import random

import corpus_pipeline as pipeline
from twinfold.llm import registry


def corpus(spark, folder):
    rng = random.Random(12)
    word = {"aa": ["the", "ing", "ou", "wh"], "bb": ["sch", "ung", "pf", "ein"]}
    say = lambda k, n: ["".join(rng.choice(word[k]) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    bench = [(k, " ".join(say("aa", 25))) for k in range(5)]
    shared = say("aa", 60)
    rows = []
    for k in range(160):
        lang = "ab"[k % 2] * 2
        w = say(lang, rng.randint(30, 90))
        if k % 20 == 4:
            w += shared
        if k % 20 == 6:
            w += bench[k % 5][1].split()
        rows.append((k, " ".join(w), lang, f"src{k % 3}", 0))
    rows += [(200, rows[3][1], "bb", "src1", 0), (201, rows[3][1] + " x", "bb", "src1", 0), (202, None, "aa", None, None), (203, "12 34", None, "src1", 5), (204, " ".join(shared), "aa", "src2", 0)]
    rows = [(d, t, la, s, len(t or "")) for d, t, la, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench, shared


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    rows, bench, shared = corpus(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == list(pipeline.COLUMNS)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in seen[name].values())
    clean = {r[0] for r in rows} - {202, 203}
    assert set(seen["language"]) == clean
    assert set(seen["near_dedup"]) == clean - {200, 201}
    holders = [r[0] for r in rows if r[1] and " ".join(shared) in r[1]]
    assert sum(" ".join(shared) in r.text for r in seen["substring_dedup"].values()) == 1 and " ".join(shared) in seen["substring_dedup"][min(holders)].text
    assert 204 not in seen["substring_dedup"]
    leaks = {r[0] for r in rows if r[1] and any(b in r[1] for _, b in bench)}
    assert leaks and set(seen["decontamination"]) == set(seen["substring_dedup"]) - leaks
    packed = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])


def test_empty_tables_and_long_texts(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("some", [(k, f"some words {k} " * (60_000 if k == 3 else 9), "aa", None, 0) for k in range(8)] + [(None, None, None, None, None)])):
        at = str(tmp_path / name)
        spark.createDataFrame(rows, shape).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = pipeline.run(spark, at).collect()
        assert bool(got) == bool(rows) and (not rows or {r.doc_id for r in got} <= set(range(8)))


def test_registry():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "decontamination", "packing"]
