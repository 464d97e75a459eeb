"""Exact k-means on integer vectors by bit planes.

A vector of 64 integers is packed, plane by plane, into one 64-bit word for each bit of two's complement, the sign plane
last. The product of a vector and a centroid is the sum over their planes i, j of weight i * weight j * popcount(plane i AND
plane j), with the sign plane's weight negative; with the squared norms it gives exact squared distances. Packed vectors are
staged once, and each round reads them: a task assigns its vectors and adds up their components by cluster from the planes, a row
a cluster leaves it, and the sums of all are a few rows.

Defined results: vectors that are null, of another number of components, or hold null or non-finite ones take no part, nor
do those with a component whose integer reaches 2^27 in magnitude, as squared distances would not fit a long; repeated rows count
each; null ids come last when centroids are first chosen; with fewer vectors than clusters each is a centroid; an empty
table gives no rows; an inertia beyond a long is null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import drop, stage

COMPONENTS, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
#: Integers' magnitudes stay below this, so that 64 squared differences fit a long.
LIMIT = 1 << 27
#: Vectors taken at a time.
BATCH = 4096
_PLACE = np.uint64(1) << np.arange(COMPONENTS, dtype=np.uint64)


def integers(v: Column) -> Column:
    """floor(SCALE * x) of each component, null where the vector takes no part."""
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LIMIT / SCALE)
    return F.when((F.size(v) == COMPONENTS) & F.forall(v, fine), scaled)


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """(vectors, planes) words of (vectors, 64) integers."""
    out = np.empty((len(x), planes), np.uint64)
    for i in range(planes):
        out[:, i] = np.where((x >> i) & 1, _PLACE, np.uint64(0)).sum(1, dtype=np.uint64)
    return out


def weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def unpack(words: np.ndarray) -> np.ndarray:
    """The (vectors, 64) integers again."""
    out = np.zeros((len(words), COMPONENTS), np.int64)
    for i, w in enumerate(weights(words.shape[1])):
        out += w * np.unpackbits(np.ascontiguousarray(words[:, i]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return out


def products(words: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) dot products of packed vectors."""
    out = np.zeros((len(words), len(centroids)), np.int64)
    w = weights(words.shape[1])
    for i in range(words.shape[1]):
        for j in range(words.shape[1]):
            out += w[i] * w[j] * np.bitwise_count(words[:, i, None] & centroids[None, :, j]).astype(np.int64)
    return out


def nearest(words: np.ndarray, norms: np.ndarray, centroids: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equals, and its squared distance."""
    d = norms[:, None] - 2 * products(words, packed) + (centroids * centroids).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def _words(column: pa.Array, planes: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, planes)


def _packed(vectors: DataFrame, planes: int) -> DataFrame:
    """(id, planes, norm) of the vectors (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, COMPONENTS)
                words = pa.ListArray.from_arrays(pa.array(np.arange(0, planes * len(x) + 1, planes, dtype=np.int32)), pa.array(pack(x, planes).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), words, pa.array((x * x).sum(1))], names=["id", "planes", "norm"])

    return vectors.select("id", "x").mapInArrow(run, vectors.select("id").schema.add("planes", T.ArrayType(T.LongType())).add("norm", "long"))


def _sums(packed: DataFrame, centroids: np.ndarray, planes: int) -> DataFrame:
    """(cluster, n, s0 ... s63): component sums of the vectors nearest to each centroid, a row a task and cluster."""
    known = pack(centroids, planes)
    names = ["cluster", "n", *[f"s{i}" for i in range(COMPONENTS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), COMPONENTS), np.int64)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                words = _words(part.column(0), planes)
                cluster, _ = nearest(words, part.column(1).to_numpy(), centroids, known)
                order = np.argsort(cluster, kind="stable")
                here, first = np.unique(cluster[order], return_index=True)
                sums[here] += np.add.reduceat(unpack(words[order]), first, axis=0)
                n += np.bincount(cluster, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), *[pa.array(sums[some, i]) for i in range(COMPONENTS)]], names=names)

    return packed.select("planes", "norm").mapInArrow(run, ", ".join(f"{c} {'int' if c == 'cluster' else 'long'}" for c in names))


def _assigned(packed: DataFrame, centroids: np.ndarray, planes: int) -> DataFrame:
    known = pack(centroids, planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                cluster, distance = nearest(_words(part.column(1), planes), part.column(2).to_numpy(), centroids, known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return packed.mapInArrow(run, packed.select("id").schema.add("cluster", "integer").add("distance", "long"))


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that takes part, staged, and the final centroids. ``clusters`` is a bound on what the driver holds."""
    rows = vectors.select(F.col(vec_id).alias("id"), integers(F.col(vector)).alias("x")).filter(F.col("x").isNotNull())
    low, high = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if low is None:
        return rows.select(F.col("id").alias(vec_id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, COMPONENTS), np.int64)
    planes = max(int(high), -int(low) - 1).bit_length() + 1
    drawn = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.orderBy(drawn.asc_nulls_last(), "x").limit(clusters).collect()
    centroids = np.array([r["x"] for r in chosen], np.int64)
    packed = stage(_packed(rows, planes), "planes")
    for _ in range(rounds):
        sums = _sums(packed, centroids, planes).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(COMPONENTS)])
        for r in sums.collect():  # a row a cluster
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(COMPONENTS)]
    out = stage(_assigned(packed, centroids, planes).withColumnRenamed("id", vec_id), "assigned")
    drop(packed)
    return out, centroids


def op_cluster(vectors: DataFrame) -> DataFrame:
    assigned, centroids = cluster(vectors)
    table = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    known = vectors.sparkSession.createDataFrame(table, "cluster int, centroid_sha256 string")  # a row a cluster
    fits = lambda c: F.expr(f"try_cast({c} AS bigint)")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = sums.agg(F.sum("own").alias("total"))
    known = known.join(sums, "cluster").crossJoin(F.broadcast(total))
    joined = assigned.join(F.broadcast(known), "cluster")
    return joined.select("vec_id", "cluster", "distance", fits("own").alias("cluster_inertia"), fits("total").alias("inertia"), "centroid_sha256")
