"""Token ids of whole texts by the tokenizers library, each distinct segment of a text encoded once.

Byte-level BPE with the usual word pattern never merges across some places: before a single space that a word
follows, between an ASCII letter and ASCII punctuation after it, and around a line break between two words. Texts
are cut there by numpy; Arrow's dictionary encoding finds the distinct segments, and the library encodes those
that the worker has not met. Joining the ids of the segments gives what encoding the whole text gives.

The library's own setting holds for the strings of added tokens (like an end mark) in a text: it makes them their
ids. With ``plain=True`` they are ordinary text. No segment is cut inside such a string.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from ._words import chunks, hash_spans, mix

#: Segments that a worker remembers; beyond, it keeps those of its last batch.
REMEMBERED = 1_000_000
#: Bytes of text that are looked at together, and segments that the library encodes together.
BATCH, TOGETHER = 2 << 20, 5_000
#: Segments that are one text for the library.
JOINED = 50

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT &= ~_LETTER & ~_DIGIT
_PLAIN = _LETTER | _DIGIT | _PUNCT
#: First bytes that no white space character, ASCII or not, begins with.
_BEGINS = np.ones(256, bool)
_BEGINS[:33] = False
_BEGINS[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_BEGINS[0x80:0xC0] = False


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """The ids of segments by two hashes of theirs: entries in the order they came, found by open addressing."""

    def __init__(self) -> None:
        self.n, self.used = 0, 0
        self.slot = np.full(1 << 16, -1, np.int32)
        self.hash, self.check, self.start, self.size = (np.zeros(1 << 15, t) for t in (np.uint64, np.uint64, np.int64, np.int32))
        self.ids = np.zeros(1 << 16, np.uint32)

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The entry of each segment; -1 for one that is not known."""
        mask = np.uint64(len(self.slot) - 1)
        out, todo, at = np.full(len(h), -1), np.arange(len(h)), h & mask
        while len(todo):
            one = self.slot[at]
            hit = (one >= 0) & (self.hash[one] == h[todo]) & (self.check[one] == c[todo])
            out[todo[hit]] = one[hit]
            on = (one >= 0) & ~hit
            todo, at = todo[on], at[on] + np.uint64(1) & mask
        return out

    def _place(self, todo: np.ndarray) -> None:
        mask = np.uint64(len(self.slot) - 1)
        at = self.hash[todo] & mask
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # one of those that meet here stays
            on = self.slot[at] != todo
            todo, at = todo[on], at[on] + np.uint64(1) & mask

    def add(self, h: np.ndarray, c: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """New entries from number ``n`` on, with their ids one after another."""
        a, b = self.n, self.n + len(h)
        if b > len(self.hash):
            more = max(len(self.hash), len(h))
            self.hash, self.check, self.start, self.size = (np.concatenate((x, np.zeros(more, x.dtype))) for x in (self.hash, self.check, self.start, self.size))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(flat), self.used), np.uint32)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.hash[a:b], self.check[a:b], self.size[a:b] = h, c, size
        self.start[a:b] = self.used + np.cumsum(size, dtype=np.int64) - size
        self.n, self.used = b, self.used + len(flat)
        if 2 * b > len(self.slot):
            self.slot = np.full(1 << (4 * b - 1).bit_length(), -1, np.int32)
            a = 0
        self._place(np.arange(a, b, dtype=np.int32))


@lru_cache(4)
def loaded(path: str, plain: bool = False):
    """(tokenizer, its memory, bytes of each token, strings of its added tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if plain:
        t.encode_special_tokens = True
    pieces = t.get_vocab(with_added_tokens=True)
    width = np.zeros(max(pieces.values(), default=0) + 1, np.int64)
    for piece, i in pieces.items():
        width[i] = len(piece)  # a byte-level token has a character for each byte
    return t, [Memory()], width, [] if plain else [x.content.encode() for x in t.get_added_tokens_decoder().values()]


def cuts(data: np.ndarray, off: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Sorted places, with the ends of all texts, between which segments can be encoded alone; none inside the strings ``whole`` or the white space before them."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        at = np.flatnonzero(data[1:-1] == 32) + 1
        cut[at[_BEGINS[data[at + 1]]]] = True
        at = np.flatnonzero(_PUNCT[data[1:]]) + 1
        cut[at[_LETTER[data[at - 1]]]] = True
        at = np.flatnonzero(data[1:-1] == 10) + 1
        line = at[_PLAIN[data[at - 1]] & _PLAIN[data[at + 1]]]
        cut[line] = cut[line + 1] = True
    flat = b""
    for x in whole:
        flat = flat or data.tobytes()
        at = flat.find(x)
        while at >= 0:
            cut[len(flat[:at].rstrip()) + 1 : at + len(x)] = False
            at = flat.find(x, at + 1)
    cut[off] = True
    return np.flatnonzero(cut)


def _segment_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), off


def segment_ids(lib, words: pa.Array, width: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all segments, how many each has). ``width``: bytes of each token.

    Segments that begin with a space and a word can follow anything without merging, so many are given to the library
    as one text, and the bytes of the ids tell them apart again. Others, and all where that does not come out even or an
    added token's string shows up, are encoded each by itself.
    """
    data, off = _segment_bytes(words)
    text = data[off[0] : off[-1]].tobytes()
    off = off - off[0]
    data = np.frombuffer(text, np.uint8)
    first = off[:-1][off[1:] - off[:-1] > 1]
    joins = np.zeros(len(words), bool)
    joins[off[1:] - off[:-1] > 1] = (data[first] == 32) & _BEGINS[data[first + 1]]
    if any(x in text for x in whole):
        joins[:] = False
    # a run begins with any segment and goes on with such as may follow
    at = np.flatnonzero(~joins | (np.arange(len(joins)) % JOINED == 0))
    ends = np.append(off[at], off[-1])
    made = lib.encode_batch_fast([text[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], add_special_tokens=False)
    flat = np.fromiter(chain.from_iterable(e.ids for e in made), np.uint32)
    upto = np.cumsum(width[flat]) if len(flat) else np.zeros(0, np.int64)
    last = np.searchsorted(upto, off[1:])
    if len(flat) and upto[-1] == off[-1] and (upto[last] == off[1:]).all():
        return flat, np.diff(last + 1, prepend=0)
    ids = [e.ids for e in lib.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size


def encode(texts: pa.Array, path: str, plain: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets of each text in the ids and the end)."""
    lib, memory, width, whole = loaded(path, plain)
    for row, data, off in chunks(texts, BATCH):
        at = cuts(data, off, whole)
        if len(at) < 2:
            yield row, np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
            continue
        segments = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = segments.dictionary
        bytes_, off_words = _segment_bytes(words)
        h = hash_spans(bytes_, off_words[:-1], off_words[1:])
        c = mix(h ^ hash_spans(bytes_[::-1], len(bytes_) - off_words[1:], len(bytes_) - off_words[:-1]))
        if memory[0].n > REMEMBERED:
            memory[0] = Memory()
        known = memory[0]
        at_word = known.find(h, c)
        new = np.flatnonzero(at_word < 0)
        at_word[new] = known.n + np.arange(len(new))
        for i in range(0, len(new), TOGETHER):
            some = new[i : i + TOGETHER]
            known.add(h[some], c[some], *segment_ids(lib, words.take(pa.array(some)), width, whole))
        which = segments.indices.to_numpy()
        flat, first, n = known.ids, known.start[at_word][which], known.size[at_word][which]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
        place += np.repeat(first - (ends - n), n)
        total = np.concatenate(([0], ends))
        yield row, flat[place], total[np.searchsorted(at, off)]
    pa.default_memory_pool().release_unused()  # else each worker holds on to what its largest batch took
