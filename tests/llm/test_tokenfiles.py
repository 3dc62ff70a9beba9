import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
import pytest

from twinfold.llm import tokenfiles
from twinfold.llm.tokens import encoder, vocabulary


def rows():
    return [(k * 7 % 101, f"word{k} and another " * (k % 40)) for k in range(101)] + [(500, None), (501, ""), (501, ""), (None, "last"), (502, "long " * 20_000)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(spark, tmp_path, monkeypatch, name):
    path, folder = vocabulary(name), f"file://{tmp_path}/out"
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as start")
    manifest = tokenfiles.write_tokens(df, folder, path, parts=3)
    got = tokenfiles.read_tokens(manifest, folder).collect()
    own = encoder(path)
    want, at = [], 0
    for d, t in sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_sequences_are_views(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "ROWS", 3)
    w = tokenfiles.PartWriter(str(tmp_path), 0, np.uint16, length=8)
    docs = [np.arange(n, dtype=np.uint32) + 2 for n in (0, 5, 40, 7, 1, 30)]
    for k, ids in enumerate(docs):
        w.add(k, ids)
    n, n_docs = w.close()
    assert n == sum(map(len, docs)) + len(docs) and n_docs == len(docs)
    r = tokenfiles.PartReader(str(tmp_path), 0)
    every = np.concatenate([np.append(d, 1) for d in docs])
    for i in range(-(-n // 8)):
        ids, mask = r.sequence(i)
        assert len(ids) == 8 and mask.to_pylist() == [8 * i + k < n for k in range(8)]
        filled = min(8, n - 8 * i)
        assert (ids[:filled] == every[8 * i : 8 * i + filled]).all() and not ids[filled:].any()
        assert not ids.flags.owndata
    whole = list(pa.ipc.open_stream(f"{tmp_path}/part-000000.tokens"))
    assert {len(b) for b in whole[:-1]} == {3} and all(r.batch(i).equals(b) for i, b in reversed(list(enumerate(whole))))
    monkeypatch.setattr(tokenfiles, "file_system", lambda folder: (pa.fs.SubTreeFileSystem(folder, pa.fs.LocalFileSystem()), ""))
    far = tokenfiles.PartReader(str(tmp_path), 0)  # as a store that has no memory maps
    assert [far.sequence(i)[0].tolist() for i in (5, 0, 11)] == [r.sequence(i)[0].tolist() for i in (5, 0, 11)]
    for x in r.index():
        for s, k, d in zip(x["start"].to_pylist(), x["n_tokens"].to_pylist(), x["doc_id"].to_pylist()):
            assert r.ids(s, k).tolist() == [*docs[d].tolist(), 1]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest = tokenfiles.write_tokens(df, str(tmp_path), vocabulary("word_bpe_49k.json"), parts=2)
    assert tokenfiles.read_tokens(manifest, str(tmp_path)).count() == 0
