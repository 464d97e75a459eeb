"""Segments of texts, told to the tokenizer many at a time and remembered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from geolathe.llm import _bpe
from geolathe.llm._words import mix


class _Counting:
    """The tokenizer, with the number of texts that it was given."""

    def __init__(self, lib) -> None:
        self.lib, self.texts = lib, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.texts += len(texts)
        return self.lib.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_new_segments_go_to_the_tokenizer_many_at_a_time():
    tokenizer = Tokenizer.from_file(_bpe.tokenizer_file())
    lib, _, width, whole = _bpe.loaded(_bpe.tokenizer_file())
    words = [f" wörd{i}" for i in range(2000)] + ["\n", "  ", "plain", ",", " ", " é", "\n\n  ", " x\t", "123", " 'twas"]
    counting = _Counting(lib)
    ids, size = _bpe.segment_ids(counting, pa.array(words), width, whole)
    at = np.append(0, np.cumsum(size))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert counting.texts < 60
    # an added token's string, and a table of widths that does not fit, fall back to segments by themselves
    odd = [*words, " <|endoftext|>", "a<|endoftext|>"]
    for x, w in ((odd, width), (words, width + 1)):
        ids, size = _bpe.segment_ids(lib, pa.array(x), w, whole)
        at = np.append(0, np.cumsum(size))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(s, add_special_tokens=False).ids for s in x]


def test_memory_of_segments_finds_each_by_both_hashes():
    memory = _bpe.Memory()
    c = np.arange(90_000, dtype=np.uint64)
    h = mix(c // np.uint64(3))  # three of one hash, the other tells
    for a in range(0, len(h), 30_000):
        some = slice(a, a + 30_000)
        assert (memory.find(h[some], c[some]) < 0).all()
        memory.add(h[some], c[some], np.arange(a, a + 30_000, dtype=np.uint32), np.ones(30_000, np.int64))
    at = memory.find(h, c)
    assert (at == np.arange(90_000)).all() and (memory.ids[memory.start[at]] == np.arange(90_000)).all()
    assert (memory.find(h, c + np.uint64(90_000)) < 0).all()
