import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.llm import tokens

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
SIGNS = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0　 ​̈abAB'sSéß中1!<|>#\x00﻿\U0001d54f"


def same(name, texts):
    path = tokens.vocabulary(name)
    own = tokens.encoder(path)
    for t, got in zip(texts, tokens.encoded(path, pa.array(texts, pa.string()))):
        assert got.tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", NAMES)
def test_random_signs(name):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    same(name, [*texts, "a <|endoftext|> b", None, "", "word " * 5000])


@pytest.mark.parametrize("name", NAMES)
def test_words_of_letters(name):
    rng = random.Random(7)
    assert tokens.encoder(tokens.vocabulary(name)).direct
    word = lambda: "".join(rng.choice("aeiourstnlABCéÉßÿ×ªıŁ'.,!z") for _ in range(rng.randint(1, 14)))
    same(name, [" ".join(word() for _ in range(40)) for _ in range(300)])
    same(name, ["\n".join(word() for _ in range(5)) for _ in range(300)] + [" the  The\tTHE\n\nthe"])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(name, texts):
    same(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_small_tables(name, monkeypatch):
    """Generations that turn over all the time change no id."""
    monkeypatch.setattr(tokens.WordTable, "MOST", 5)
    monkeypatch.setattr(tokens, "HELD", 4)
    rng = random.Random(2)
    same(name, [" ".join("ab"[rng.randrange(2)] * rng.randint(1, 9) for _ in range(20)) for _ in range(300)])


def thue_morse(n, turned=0):
    return "".join("ab"[(bin(k).count("1") + turned) % 2] for k in range(n))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("n", [16, 64, 1024, 2048])
def test_words_that_polynomials_confuse(name, n):
    same(name, [f"x {thue_morse(n)} y", f"x {thue_morse(n, 1)} y", f"x\n{thue_morse(n)} y"])


@pytest.mark.parametrize("name", NAMES)
def test_equal_hashes_change_no_id(name, monkeypatch):
    """Words count as known by their bytes, whatever their hashes."""
    monkeypatch.setattr(tokens, "word_hashes", lambda raw, starts, ends, key: ((ends - starts) % 3 + 5).astype(np.uint64))
    monkeypatch.setattr(tokens.WordTable, "MOST", 2)
    tokens.encoder.cache_clear()
    rng = random.Random(3)
    same(name, [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(30)) for _ in range(40)])
    tokens.encoder.cache_clear()


def test_many_distinct_words_in_one_text(monkeypatch):
    monkeypatch.setattr(tokens, "PORTION", 1000)
    monkeypatch.setattr(tokens.WordTable, "MOST", 1500)
    monkeypatch.setattr(tokens.WordTable, "BITS", 13)
    tokens.encoder.cache_clear()
    same(NAMES[1], [" ".join(f"w{k}" for k in range(9000))])
    tokens.encoder.cache_clear()


def test_table_finds_what_was_put():
    t = tokens.WordTable()
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64) | np.uint64(0xFFFF << 47))
    raw = rng.integers(97, 123, 20 * len(h)).astype(np.uint8)
    size = rng.integers(1, 20, len(h))
    words = tokens.Words(tokens.lanes_of(raw), np.arange(len(h)) * 20, size, np.zeros(len(h), np.int64))
    t.put(h[::2], words.take(np.s_[::2]), np.arange(len(h[::2]), dtype=np.uint32), np.ones(len(h[::2]), np.int64))
    found = t.find(h)
    assert (found[::2] == np.arange(len(h[::2]))).all() and (found[1::2] == -1).all()
    assert t.same(found, words)[::2].all() and not t.same(found, words)[1::2].any()
    other = words.take(np.s_[::2])
    other.starts = other.starts[::-1]
    assert t.same(found[::2], other).sum() < len(found) // 100
