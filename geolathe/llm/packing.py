"""Packing whole texts into windows of tokens with lexical neighbours.

Texts are put in order of a minhash of their token pairs, which brings like texts together, and the order is cut
into ranges. A task walks its range in shards of a bounded number of texts. A shard has a BM25 inverted index
with statistics of the whole corpus. A seed's window is filled with unused neighbours in order of their score:
the best that fits, again and again; if none fits, the best is cut at the end of the window, and its rest is the
next seed. So windows are full, but for the last of a range.

Defined results: a null or empty text is its end id; an id lies in exactly one piece; repeated rows are packed
each; texts without neighbours follow in order; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._tables import stage
from ._words import mix

LENGTH = 1024
END_ID = 0
SHARD_DOCS = 256
SHARD_IDS = 4_000_000
K1, B = 1.2, 0.75
_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _encoded(docs: DataFrame, path: str, end_id: int, kind: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], kind).tobytes()
        for batch in batches:
            for row, ids, off in _bpe.encode(batch.column(1), path):
                pairs = mix(ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:]) if len(ids) > 1 else np.zeros(0, np.uint64)
                low = np.zeros(len(off) - 1, np.uint64)
                full = np.flatnonzero(off[1:] - off[:-1] > 1)
                if len(full):
                    pairs[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(ids))] - 1] = ~np.uint64(0)  # across two texts
                    low[full] = np.minimum.reduceat(pairs, off[full])
                ids = ids.astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(off) - 1), pa.array([ids[a:b].tobytes() + tail for a, b in zip(off[:-1], off[1:])], pa.binary()), pa.array(low.view(np.int64))], names=["doc_id", "ids", "near"])

    return docs.mapInArrow(run, "doc_id long, ids binary, near long")


def _statistics(tokens: DataFrame, kind: type, vocabulary: int) -> tuple[np.ndarray, float]:
    """(inverse document frequency of each id, mean length) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last, docs, length = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                ids = np.frombuffer(x, kind)
                place = np.arange(len(ids))
                last[ids] = place
                df[ids[last[ids] == place]] += 1  # each id once, where it stands last
                docs += 1
                length += len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1, -2], pa.int64()), pa.array([*df[some], docs, length], pa.int64())], names=["id", "n"])

    # at most a row for each id of the vocabulary
    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(rows["id"].tolist(), rows["n"].tolist()))
    docs, length = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(vocabulary)
    df[list(n)] = list(n.values())
    return np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32), length / max(docs, 1)


class _Index:
    """BM25 postings of one shard."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.texts = texts
        size = np.array([len(t) for t in texts])
        # one sorted number for each place of an id: the id, then the text
        pairs = np.concatenate(texts).astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), size)
        pairs.sort()
        new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        tf = np.diff(np.append(new, len(pairs))).astype(np.float32)
        term = pairs[new] // len(texts)
        self.doc = (pairs[new] - term * len(texts)).astype(np.int32)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size.astype(np.float32)[self.doc] / mean))
        self.first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        self.known, self.n = term[self.first], np.diff(np.append(self.first, len(term)))
        self.size = len(texts)

    def terms(self, text: int) -> np.ndarray:
        ids = np.sort(self.texts[text])
        return ids[np.concatenate(([True], ids[1:] != ids[:-1]))]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        at = at[self.known[at] == terms]
        n = self.n[at]
        ends = np.cumsum(n)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - (ends - n), n)
        return np.bincount(self.doc[rows], self.weight[rows], self.size)


class _Packer:
    """Fills windows shard by shard; the window that is open at a shard's end goes on in the next."""

    def __init__(self, idf: np.ndarray, mean: float, base: int, length: int = LENGTH) -> None:
        self.idf, self.mean, self.length = idf, mean, length
        self.sequence, self.used, self.last = base, 0, None
        self.out: list[tuple] = []

    def _put(self, doc_id, ids: np.ndarray, start: int, n: int) -> None:
        piece = ids[start : start + n].astype("<u4")
        self.out.append((doc_id, start, n, zlib.crc32(piece), len(ids), self.sequence, self.used))
        self.used += n
        if self.used == self.length:
            self.sequence, self.used = self.sequence + 1, 0

    def _place(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            n = min(self.length - self.used, len(ids) - start)
            self._put(doc_id, ids, start, n)
            start += n

    def shard(self, names: list, texts: list[np.ndarray]) -> None:
        index = _Index(texts, self.idf, self.mean)
        size = np.array([len(t) for t in texts])
        free = np.ones(len(texts), bool)
        at = 0
        while True:
            if self.used == 0 or self.last is None:
                while at < len(texts) and not free[at]:
                    at += 1
                if at == len(texts):
                    return
                free[at] = False
                self._place(names[at], texts[at])
                self.last = index.terms(at)
                continue
            score = index.scores(self.last)
            score[~free] = -1
            order = np.argsort(-score, kind="stable")[: int(free.sum())]
            if not len(order):
                return
            left = size[order]
            i = 0
            while self.used and len(order):
                fits = np.flatnonzero(left[i:] <= self.length - self.used)
                if not len(fits):
                    break
                i += int(fits[0])
                one = int(order[i])
                free[one] = False
                self._place(names[one], texts[one])
                i += 1
            if self.used:
                rest = order[free[order]]
                if not len(rest):
                    return
                one = int(rest[0])
                free[one] = False
                self._place(names[one], texts[one])
                self.last = index.terms(one)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [[] for _ in _PIECE]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PIECE)], names=[n for n, _ in _PIECE])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or _bpe.tokenizer_file()
    vocabulary = max(_bpe.loaded(path)[0].get_vocab_size(), end_id + 1)
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    tokens = stage(_encoded(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), path, end_id, kind), "tokens")
    idf, mean = _statistics(tokens, kind, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(idf, mean, TaskContext.get().partitionId() << 36, length)
        names, texts, held = [], [], 0
        for batch in batches:
            for one, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(one), texts.append(np.frombuffer(ids, kind))
                held += len(texts[-1])
                if len(names) >= SHARD_DOCS or held >= SHARD_IDS:
                    packer.shard(names, texts)
                    names, texts, held = [], [], 0
                    yield packer.take()
        if names:
            packer.shard(names, texts)
            yield packer.take()

    ordered = tokens.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id", F.crc32("ids"))
    return ordered.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
