import math
import zlib

import pytest
import xxhash

from twinfold.llm import sharding


def brute(key, weights, shards):
    def score(i, w):
        h = xxhash.xxh64_intdigest(f"shard:{i}:{key}".encode(), 42) >> 12
        return -math.log((h + 0.5) / 2**52) / w

    return min(range(shards), key=lambda i: score(i, weights[i]))


def docs(spark):
    rows = [(k, "x" * (k % 50), "a") for k in range(400)] + [(7, None, "b"), (7, None, "b"), (None, "ü", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string")


def test_against_brute_force(spark):
    got = sharding.shard_documents(docs(spark)).collect()
    assert len(got) == 403
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute(key, [1.0] * 41, 40)
        assert r.grown_shard == brute(key, [1.0] * 41, 41)
        assert r.grown_shard in (r.shard, 40)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    one = next(r for r in got if r.doc_id is None)
    assert (one["size"], one.text_crc32) == (18, zlib.crc32("ü".encode()))


def test_weights_and_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 1)
    base = spark.range(6000).withColumnRenamed("id", "doc_id")
    got = sharding.assign(base, "doc_id", [1.0, 3.0])
    share = got.where("shard = 1").count() / 6000
    assert 0.72 < share < 0.78
    numbered = sharding.number(got, "shard", ["doc_id"], 6000).collect()
    for k in (0, 1):
        s = sorted(r.slot for r in numbered if r.shard == k)
        assert s == list(range(len(s)))


def test_equal_rows_and_clashing_names(spark):
    base = spark.createDataFrame([(7, "same", 1)] * 500 + [(k, "x", k) for k in range(100)], "doc_id long, row string, n long").selectExpr("*", "n as best", "n as part", "n as new")
    got = sharding.number(sharding.assign(base, "doc_id", [1.0] * 3), "shard", ["doc_id"], 600).collect()
    assert len(got) == 600 and all(r.best == r.part == r.new == r.n for r in got) and sum(r.row == "same" for r in got) == 500
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    for f in (lambda: sharding.assign(base.withColumnRenamed("n", "shard"), "doc_id", [1.0]), lambda: sharding.number(base.withColumnRenamed("n", "slot"), "part", ["doc_id"], 9)):
        with pytest.raises(ValueError):
            f()


def test_empty(spark):
    assert sharding.shard_documents(docs(spark).limit(0)).count() == 0
