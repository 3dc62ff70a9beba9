"""Token ids from public tokenizers, a piece of text at a time.

Both vocabularies cut a text into pre-tokens that never run from a character that is
not white space into white space, so the ids of a text are the ids of its pieces (white
space, then anything else) one after another. Pieces repeat; each is encoded by
the tokenizers library once and looked up after that, all words of a slice at once: a 64-bit
hash finds the entry, whose bytes are then compared with the word's. What is held is bounded
(two generations: of a full table only what is met again stays), which changes no id. Texts
with unusual white space or special tokens take a slower way with the same result.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .common import _TAKE, BLANK, lanes_of, slices, text_buffers, word_hashes, word_spans

#: Pieces that a worker holds at most (about 0.25 KB each), and length of the longest that it holds.
HELD, LONGEST = 100_000, 64
#: Words that are looked up at a time.
PORTION = 250_000
#: Each worker hashes in its own way, so no text can be made to fill one slot.
KEY = int.from_bytes(os.urandom(8), "little")

#: White space in the sense of the tokenizers' patterns.
_WHITE = frozenset(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_W = "".join(sorted(_WHITE))
_PIECE = re.compile(rf"[{_W}]*[^{_W}]+|[{_W}]+")
#: Characters that str.split() takes for white space and the tokenizers do not.
_SPLIT_ONLY = re.compile("[\x1c-\x1f]")
#: Pieces that are joined for one call.
JOINED = 64
#: Plain words: Latin letters, maybe one sign behind them, which is a pre-token of its own.
_SIGNS = ".,!?;:"
_WORDY = re.compile(rf"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([{_SIGNS}]?)")
#: Words that a model is tried on.
_SAMPLE = ("a", "I", "the", "The", "don", "Unbelievable", "xkcd", "ABBA", "internationalisation", "McDonald", "a" * 24, "\u00e9t\u00e9", "\u00c9cole", "\u00dcber\u00dfe", "ma\u00f1ana", "\u00ff\u00c0")
#: Byte-level models see a byte as a printable sign: itself, or (bytes without one) the signs from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE_SIGN = _BYTE_SIGNS[32]
#: Marks a word at the beginning of a line; no text has it.
HEAD = "\ud800"


class _Held(dict):
    """Pieces to ids as bytes. A piece that is not held comes from the older generation, or
    is noted as pending."""

    def __init__(self):
        self.older: dict[str, bytes] = {}
        self.pending: dict[str, None] = {}

    def __missing__(self, piece: str):
        got = self.older.get(piece)
        if got is None:
            self.pending[piece] = None
        else:
            self[piece] = got
        return got

    def turn(self) -> None:
        """What is held becomes the older generation."""
        self.older = dict(self)
        self.clear()


class Encoder:
    """Ids for a tokenizer file; equal to encode(text, add_special_tokens=False).ids, with
    the strings of special tokens taken as the file's own rules take them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: the same ids without offsets, where the library has it
        self.fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.held = _Held()
        #: a text that holds a special token's string is encoded whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: whether white space leaves no trace, so that pieces are plain words
        self.words_only = not plain(" \n\t ") and plain(" a\n\tb ") == plain("a") + plain("b")
        #: what missing pieces are joined by, and its one id
        self.joint = " | " if self.words_only else "\n"
        self.mark = plain(self.joint)
        self.mark_bytes = np.array(plain("\n"), np.uint32).tobytes()
        self.table = WordTable()
        #: whether the model itself may be given plain words
        self.direct = self._probed(plain)

    def _probed(self, plain) -> bool:
        """Tries whether the library does no more to plain words (see _WORDY) than lower them where
        white space is dropped, write their bytes as signs, and give them to the model."""
        keys = [lead + w + c for w in _SAMPLE for c in ("", *_SIGNS) for lead in ("", HEAD)]
        self.direct = True
        try:
            self.sign_ids = {c: [x.id for x in self.tokenizer.model.tokenize(c)] for c in _SIGNS}
            got = self.encode_pieces(keys)
        except Exception:  # noqa: BLE001  a model of another kind
            return False
        actual = lambda k: k[1:] if k[0] == HEAD else k if self.words_only else " " + k
        return all(np.frombuffer(got[k], np.uint32).tolist() == plain(actual(k)) for k in keys)

    def pieces(self, text: str) -> list[str]:
        """Keys of the pieces of a text. Where white space is dropped: the words. Else a key
        without white space is a word behind one space, HEAD and a word is that word alone,
        and anything else is the piece as it stands."""
        words = text.split()
        if self.words_only:
            return _PIECE.findall(text) if _SPLIT_ONLY.search(text) else words
        n = len(words) - 1
        if n >= 0 and n == text.count(" ") + text.count("\n") == len(text) - sum(map(len, words)):  # one space or newline in each gap
            out: list[str] = []
            for line in text.split("\n"):
                own = line.split(" ")
                own[0] = HEAD + own[0]
                out += own
                out.append("\n")
            out.pop()
            return out
        own = _PIECE.findall(text)
        if own and own[0][0] not in _WHITE:
            own[0] = HEAD + own[0]
        return own

    def actual(self, key: str) -> str:
        if self.words_only or key[0] in _WHITE:
            return key
        return key[1:] if key[0] == HEAD else " " + key

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pieces that are new are encoded together."""
        held, out = self.held, [None] * len(texts)
        if len(held) > HELD // 2:
            held.turn()
        waiting, lookup = [], held.__getitem__
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            own = self.pieces(text)
            got = list(map(lookup, own))
            if held.pending and None in got:
                waiting.append((i, own, got))
            else:
                out[i] = np.frombuffer(b"".join(got), np.uint32)
        if waiting:
            fresh = self.encode_pieces(list(held.pending))
            held.pending.clear()
            held.update((p, x) for p, x in fresh.items() if len(p) <= LONGEST)
            for i, own, got in waiting:
                for k, x in enumerate(got):
                    if x is None:
                        got[k] = fresh[own[k]]
                out[i] = np.frombuffer(b"".join(got), np.uint32)
        return out

    def encode_pieces(self, keys: list[str]) -> dict[str, bytes]:
        """Each piece encoded on its own. Words of ASCII letters are one pre-token, which the model
        is given as it is. Other simple pieces are joined by a sign that none of them has,
        which is an id of its own, and the library is called once for many."""
        out: dict[str, bytes] = {}
        if self.direct:
            ids, ends, done, other = [], [], [], []
            whole, signs, tokenize = _WORDY.fullmatch, self.sign_ids, self.tokenizer.model.tokenize
            space, lower = "" if self.words_only else _SPACE_SIGN, self.words_only
            for k in keys:
                lead = k[0] == HEAD
                m = whole(k, lead)
                if m is None:
                    other.append(k)
                    continue
                word, sign = m.groups()
                if lower:
                    word = word.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_BYTE_SIGNS)
                ids += [x.id for x in tokenize(word if lead else space + word)]
                if sign:
                    ids += signs[sign]
                ends.append(len(ids) * 4)
                done.append(k)
            raw = np.array(ids, np.uint32).tobytes()
            out = {k: raw[a:b] for k, a, b in zip(done, [0, *ends[:-1]], ends)}
            keys = other
        pieces = keys if self.words_only else list(map(self.actual, keys))
        if len(self.mark) != 1:
            simple = [False] * len(keys)
        elif self.words_only:
            sign = self.joint.strip()
            simple = [sign not in p and p.isprintable() for p in pieces]
        else:
            simple = [k[0] not in _WHITE and p[1:].isprintable() and " " not in p[1:] and p.strip() != "" for k, p in zip(keys, pieces)]
        rest = [i for i, x in enumerate(simple) if not x]
        some = [i for i, x in enumerate(simple) if x] if rest else range(len(keys))
        parts = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
        for i in range(0, len(parts), 128):
            texts = [self.joint.join([pieces[k] for k in part]) for part in parts[i : i + 128]]
            for part, got in zip(parts[i : i + 128], self.fast(texts, add_special_tokens=False)):
                ids = np.array(got.ids, np.uint32)
                cut = np.flatnonzero(ids == self.mark[0])
                if len(cut) != len(part) - 1:
                    rest += part
                    continue
                raw = ids.tobytes()
                starts, ends = [0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), len(raw)]
                out |= {keys[k]: raw[a:b] for k, a, b in zip(part, starts, ends)}
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            e = self.tokenizer.encode([pieces[k] for k in part], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, np.uint32).tobytes()
            ends = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part)), side="right") * 4).tolist()
            out |= {keys[k]: raw[a:b] for k, a, b in zip(part, [0, *ends[:-1]], ends)}
        return out

    def trim(self) -> None:
        """Between tasks only the newer generation is held."""
        self.held.older = {}
        self.table.trim()


class Words:
    """Words of a slice: where they begin, how long they are, and a small number that
    belongs to each as if it were one more letter."""

    def __init__(self, lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray):
        self.lanes, self.starts, self.sizes, self.kinds = lanes, starts, sizes, kinds

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, at) -> Words:
        return Words(self.lanes, self.starts[at], self.sizes[at], self.kinds[at])

    def tags(self) -> np.ndarray:
        return self.sizes * 4 + self.kinds

    def lane(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of some words; zeros behind the end."""
        return self.lanes[self.starts[at] + 8 * k] & _TAKE[np.minimum(self.sizes[at] - 8 * k, 8)]


class WordTable:
    """Ids of words, open addressing by 64-bit hash in numpy arrays; bounded in two
    generations. An entry holds the word itself, and counts only if that is the same."""

    BITS = 21
    #: Words of one generation (about 60 bytes each).
    MOST = 400_000

    def __init__(self):
        self.older: WordTable | None = None
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.at = np.zeros(1 << self.BITS, np.int32)
        self.starts, self.sizes, self.first, self.tags = (np.zeros(1 << 16, np.int32) for _ in range(4))
        self.flat, self.lanes = np.zeros(1 << 18, np.uint32), np.zeros(1 << 17, np.uint64)
        self.n = self.used = self.filled = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        mask = np.int64((1 << self.BITS) - 1)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.at[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.at[slot[hit]]
            more = ~hit & (key != 0)
            left, slot = left[more], slot[more]
        return out

    def same(self, entry: np.ndarray, words: Words) -> np.ndarray:
        """Whether each entry (-1: none) holds its word, byte for byte."""
        ok = (entry >= 0) & (self.tags[entry] == words.tags())
        left, k = np.flatnonzero(ok), 0
        while len(left):
            equal = self.lanes[self.first[entry[left]] + k] == words.lane(left, k)
            ok[left[~equal]] = False
            k += 1
            left = left[equal & (words.sizes[left] > 8 * k)]
        return ok

    @staticmethod
    def _room(held: np.ndarray, n: int) -> np.ndarray:
        while n > len(held):
            held = np.concatenate([held, np.zeros_like(held)])
        return held

    def put(self, h: np.ndarray, words: Words, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct hashes, their words, and their ids one after another."""
        count = np.maximum(1, -(-words.sizes // 8))
        self.flat = self._room(self.flat, self.used + len(ids))
        self.lanes = self._room(self.lanes, self.filled + int(count.sum()))
        self.starts, self.sizes, self.first, self.tags = (self._room(x, self.n + len(h)) for x in (self.starts, self.sizes, self.first, self.tags))
        entry = np.arange(self.n, self.n + len(h))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[entry] = self.used + np.cumsum(sizes) - sizes
        self.sizes[entry] = sizes
        self.first[entry] = self.filled + np.cumsum(count) - count
        self.tags[entry] = words.tags()
        for k in range(int(count.max(initial=0))):
            more = np.flatnonzero(count > k)
            self.lanes[self.first[entry[more]] + k] = words.lane(more, k)
        self.used, self.filled, self.n = self.used + len(ids), self.filled + int(count.sum()), self.n + len(h)
        mask = np.int64((1 << self.BITS) - 1)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)  # one newcomer for each free slot
            won = free[first]
            self.keys[slot[won]], self.at[slot[won]] = h[left[won]], entry[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & mask

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after another, and how many each has."""
        size = self.sizes[entry].astype(np.int64)
        return _gathered(self.flat, self.starts[entry], size), size

    def _learn(self, h: np.ndarray, words: Words, place: np.ndarray, encode) -> None:
        """Puts words of new, distinct hashes in, from the older generation where it has them."""
        if self.older is not None:
            held = self.older.find(h[place])
            known = self.older.same(held, words.take(place))
            if known.any():
                self.put(h[place[known]], words.take(place[known]), *self.older.ids(held[known]))
            place = place[~known]
        if len(place):
            self.put(h[place], words.take(place), *encode(place))

    def lookup(self, h: np.ndarray, words: Words, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has; encode gives the same
        for the words at some places. Words too long to hold, and such as have the hash of
        another one, are encoded each time."""
        if self.n > self.MOST:
            old = WordTable.__new__(WordTable)
            old.__dict__.update({k: v for k, v in self.__dict__.items() if k != "older"}, older=None)
            self.older = old
            self.reset()
        entry = self.find(h)
        known = self.same(entry, words)
        fresh = np.flatnonzero((entry < 0) & (words.sizes <= LONGEST))
        if len(fresh):
            _, first = np.unique(h[fresh], return_index=True)
            self._learn(h, words, fresh[first], encode)
            entry[fresh] = self.find(h[fresh])
            known[fresh] = self.same(entry[fresh], words.take(fresh))
        rest = np.flatnonzero(~known)
        if not len(rest):
            return self.ids(entry)
        more, own = encode(rest)
        size, start = self.sizes[entry].astype(np.int64), self.starts[entry].astype(np.int64)
        size[rest], start[rest] = own, self.used + np.cumsum(own) - own
        return _gathered(np.concatenate([self.flat[: self.used], more]), start, size), size

    def trim(self) -> None:
        self.older = None


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    shift = np.repeat(start - (end - size), size)
    return flat[shift + np.arange(len(shift))]


#: Two and three bytes of white space above ASCII: rows with any are left to the slower way.
_PAIRS = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))


def _odd_rows(encoder: Encoder, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that words cannot be cut out of byte by byte: special tokens and, where white space
    leaves ids, any gap but one space or newline between two words."""
    n = len(at) - 1
    odd = np.zeros(n, bool)
    row = lambda places: np.searchsorted(at, places, side="right") - 1
    text = raw.tobytes()
    for s in encoder.special:
        if s.encode() in text:
            for i in range(n):
                odd[i] |= s.encode() in text[at[i] : at[i + 1]]
    if encoder.words_only:
        return odd
    blank = BLANK[raw]
    strange = blank & (raw != 32) & (raw != 10)
    double = blank[1:] & blank[:-1]
    odd[row(np.flatnonzero(strange))] = True
    odd[row(np.flatnonzero(double))] = True
    full = np.flatnonzero(np.diff(at) > 0)
    odd[full] |= blank[at[full]] | blank[at[full + 1] - 1]
    for lead, second in _PAIRS:
        p = np.flatnonzero(raw[:-1] == lead)
        p = p[np.isin(raw[p + 1], second)] if len(p) else p
        odd[row(p)] = True
    return odd


def slice_ids(encoder: Encoder, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ids of each row of a slice of texts."""
    at = at - at[0]
    odd = _odd_rows(encoder, raw, at)
    starts, ends, before = word_spans(raw, BLANK, at)
    if encoder.words_only:
        kind = np.zeros(len(starts), np.int64)
    else:  # 0 behind a space, 1 at the beginning, 2 behind a newline
        kind = np.where(raw[np.maximum(starts - 1, 0)] == 10, 2, 0)
        kind[before[:-1][np.diff(before) > 0]] = 1
    h = word_hashes(raw, starts, ends, KEY) ^ kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h[h == 0] = 1
    even = ~np.repeat(odd, np.diff(before))
    use = np.flatnonzero(even)
    text, words = raw.tobytes(), Words(lanes_of(raw), starts, ends - starts, kind)
    line = encoder.mark_bytes
    flats, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i in range(0, len(use), PORTION):
        own = use[i : i + PORTION]

        def encode(places):
            k = own[places]  # noqa: B023  called before own changes
            keys = b"\n".join([text[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist())]).decode().split("\n")
            if not encoder.words_only:
                keys = [HEAD + w if t else w for t, w in zip(kind[k].tolist(), keys)]
            got = encoder.encode_pieces(list(dict.fromkeys(keys)))
            parts = [line + got[w] if t == 2 else got[w] for t, w in zip(kind[k].tolist(), keys)]
            return np.frombuffer(b"".join(parts), np.uint32), np.array(list(map(len, parts)), np.int64) // 4

        part, size = encoder.table.lookup(h[own], words.take(own), encode)
        flats.append(part)
        sizes.append(size)
    flat, size = np.concatenate(flats), np.concatenate(sizes)
    total = np.zeros(len(h) + 1, np.int64)
    total[1:][even] = size
    ends_at = np.cumsum(total)[before]
    out = [flat[a:b] for a, b in zip(ends_at[:-1], ends_at[1:])]
    rows = np.flatnonzero(odd).tolist()
    for i, ids in zip(rows, encoder.ids_of([text[at[i] : at[i + 1]].decode() for i in rows])):
        out[i] = ids
    return out


def encoded(path: str, column):
    """The ids of each row of a string column, null as empty, in order; for use within a task."""
    own = encoder(path)
    raw, at = text_buffers(column)
    for first, last in slices(at, 1 << 19):
        yield from slice_ids(own, raw[at[first] : at[last]], at[first : last + 1])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file in each worker. Where an executor keeps the public files in
    another folder than the driver, the file of that name is taken there."""
    return Encoder(path if os.path.exists(path) else vocabulary(os.path.basename(path)))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
