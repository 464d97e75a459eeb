"""Words of whole texts as numpy arrays, taken from the buffers of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are cut into chunks of about so many bytes (a longer text is a chunk of its own); bounds the arrays below.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C55
_P_INV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p in (_P, _P_INV):
        x = np.full(n + 1, p, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each text in the bytes and the end) over the rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, off: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than space and 9 to 13) and the text of each."""
    solid = ~blank[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    a, b = off[full], off[full + 1] - 1
    first[a], last[b] = solid[a], solid[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in the spans."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = x * np.uint64(0xA24BAED4963EE407) + h[i : i + n]
    return mix(x + np.uint64(k))


def bounds(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the items of each of ``n`` texts begin and end, for sorted owners."""
    return np.searchsorted(owner, np.arange(n + 1))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one none."""
    data = lower(data)
    starts, ends, owner = spans(data, off)
    h = hash_spans(data, starts, ends)
    at = bounds(owner, len(off) - 1)
    w = windows(h, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(w[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield windows(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def rows_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(text))


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
