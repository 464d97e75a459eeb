"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart.

A corpus is a folder of ``*.glt`` files and ``ranks.bin`` (little-endian 32-bit ids, most frequent first). A file:

    8 bytes   magic
    4, 8      number of documents, number of ids (unsigned, little-endian)
    8 each    document ids (signed)
    1 each    1 where the document's id is null
    4 each    ids of each document
    control   a byte for four ids: two bits each, bytes of its rank less one, the first id in the lowest bits
    data      the ranks, 1 to 4 bytes each, little-endian

Documents are in ascending order of their id (null first, then by a hash of the text), in files and from file to
file; the manifest gives each file's place. Files that a lost task left behind are not in the manifest.

Defined results: a null or empty text has the end id alone; repeated rows are written each; an empty table gives
an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._tables import fresh_path, running_before, small, stage

MAGIC = b"GLTFILE1"
END_ID = 2
#: A file is closed at about so many ids.
FILE_IDS = 8_000_000
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    r = ranks.astype(np.uint32)
    size = (1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    code[: len(r)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    data = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    data[at] = r & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        data[at[more] + k] = (r[more] >> np.uint32(8 * k)) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes | memoryview, data: bytes | memoryview, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    b = np.frombuffer(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = b[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= b[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    ids = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join((MAGIC, struct.pack("<IQ", len(ids), len(ranks)), ids.tobytes(), null.tobytes(), np.array(counts, "<u4").tobytes(), control, data))


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ranks)."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n = struct.unpack_from("<IQ", content, 8)
    at = 20
    ids = np.frombuffer(content, "<i8", docs, at)
    null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(content, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    view = memoryview(content)
    mid = at + -(-n // 4)
    return [None if x else int(i) for i, x in zip(ids, null)], counts, unpack_ranks(view[at:mid], view[mid:], n)


@dataclass
class Corpus:
    folder: str
    manifest: DataFrame  # file, n_docs, n_ids, before (ids in the files before)


def _tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids) in ranges and order of doc_id; ids as bytes of 16 bits where the vocabulary allows it."""
    kind = np.uint16 if _bpe.loaded(path)[0].get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, off in _bpe.encode(batch.column(1), path):
                ids = ids.astype(kind)
                tail = np.array([end_id], kind).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(off) - 1), pa.array([ids[a:b].tobytes() + tail for a, b in zip(off[:-1], off[1:])], pa.binary())], names=["doc_id", "ids"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "doc_id long, ids binary"), kind


def write_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, folder: str | None = None) -> Corpus:
    """Encode and write every text of ``docs``."""
    spark = docs.sparkSession
    path = path or _bpe.tokenizer_file()
    found, kind = _tokens(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), path, end_id)
    tokens = stage(found.withColumn("part", F.spark_partition_id()), "tokens")
    vocabulary = max(_bpe.loaded(path)[0].get_vocab_size(), end_id + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    # at most a row for each id of the vocabulary
    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(vocabulary, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ranks = np.argsort(-total, kind="stable").astype(np.uint32)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[ranks] = np.arange(vocabulary, dtype=np.uint32)
    folder = folder or fresh_path(spark, "corpus")
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/ranks.bin") as f:
        f.write(ranks.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        docs, sizes, parts, first = [], [], [], None

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), kind)
            name = f"{uuid.uuid4().hex}.glt"
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(file_bytes(docs, sizes, rank_of[ids]))
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, first[0], first[1], len(docs), len(ids))], names=["file", "part", "row", "n_docs", "n_ids"])
            docs.clear(), sizes.clear(), parts.clear()
            return out

        held = 0
        for batch in batches:
            for one, ids, part, row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if docs and (part != first[0] or row != first[1] + len(docs) or held >= FILE_IDS):
                    yield close()
                    held = 0
                if not docs:
                    first = part, row
                docs.append(one), sizes.append(len(ids) // kind().itemsize), parts.append(ids)
                held += sizes[-1]
        if docs:
            yield close()

    placed = tokens.select("doc_id", "ids", F.col("part").cast("long"), F.col("_metadata.row_index").alias("row"))
    files = stage(placed.mapInArrow(write, "file string, part long, row long, n_docs long, n_ids long"), "files")
    return Corpus(folder, running_before(files, "n_ids", ["part", "row"], parts=1 if files.limit(5000).count() < 5000 else None))


def read_corpus(spark, folder: str, digest_only: bool = True) -> DataFrame:
    """(file, doc_id, within, n_tokens, ids_crc32 or ids) of all files; within: ids of the file before the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{at}/ranks.bin") as f:
            ranks = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                docs, counts, coded = read_file(content.as_py())
                ids = ranks[coded].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                view = memoryview(ids).cast("B")
                pieces = [view[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                last = pa.array([zlib.crc32(x) for x in pieces], pa.int64()) if digest_only else pa.array([np.frombuffer(x, "<u4") for x in pieces], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(docs)), pa.array(docs, pa.int64()), pa.array(ends - counts), pa.array(counts.astype(np.int64)), last], names=["file", "doc_id", "within", "n_tokens", "ids_crc32" if digest_only else "ids"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.glt").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return content.select(name.alias("file"), "content").mapInArrow(run, "file string, doc_id long, within long, n_tokens long, " + ("ids_crc32 long" if digest_only else "ids array<long>"))


def digest(corpus: Corpus) -> DataFrame:
    spark = corpus.manifest.sparkSession
    if not corpus.manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read_corpus(spark, corpus.folder)
    files = corpus.manifest.select(F.col("file").alias("_file"), "before")
    return found.join(small(files), F.col("file") == F.col("_file")).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
