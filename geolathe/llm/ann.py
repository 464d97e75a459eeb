"""Approximate nearest neighbours by a forest of hash prefixes.

The vectors lie in blocks of a bounded size. In a block, each tree gives a vector a long hash string, a bit for each
random direction: on which side of a threshold it lies, and is the array of the block's strings in order. A query
descends every tree to where its string would stand, where the vectors with the longest common prefixes lie around
it. Then all trees ascend together, a bit at a time: the vectors that share so long a prefix with the query in any
tree are its candidates, whose distances are computed exactly. The ascent goes on until the block's best have not
changed while the candidates grew by a factor of GROWTH, or all of the block are candidates. So the number of
candidates follows from the vectors, not from a limit: well clustered ones settle after a few, vectors without
structure need most of their block.

Only each block's best leave its task. Rows with one vector are indexed as one and keep their k + 1 smallest ids,
more of which no result can need, so very common vectors neither fill a range nor crowd out others.

Defined results: vectors that are null, zero, of another dimension than most, or hold null or non-finite
components take no part, nor do rows with a null id; repeated rows count once; with fewer candidates than k all
are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import stage

K = 10
TREES = 32
BITS = 32
#: Candidates before the ascent is first judged, and by how much they must grow without a change for it to end.
FIRST, GROWTH = 400, 4.0
#: Vectors of a block at most, and queries that one pass asks.
BLOCK, PASS = 1 << 16, 20_000
#: Rows that the thresholds are fitted on, by a hash of the id.
SAMPLE = 20_000


def usable(v: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, ok) & F.exists(v, lambda x: x != 0)


class Forest:
    """Directions and thresholds of all trees."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.bits = trees, bits
        self.directions = rng.standard_normal((sample.shape[1], trees * bits)).astype(np.float32)
        at = np.sort(sample.astype(np.float32) @ self.directions, axis=0)
        place = (rng.uniform(0.3, 0.7, trees * bits) * (len(at) - 1)).astype(int)
        self.thresholds = at[place, np.arange(trees * bits)]

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, vectors) hash strings as numbers, the first bit highest."""
        weight = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        out = np.empty((self.trees, len(vectors)), np.int64)
        for at in range(0, len(vectors), 4096):
            side = (vectors[at : at + 4096].astype(np.float32) @ self.directions > self.thresholds).reshape(-1, self.trees, self.bits)
            out[:, at : at + 4096] = (side.astype(np.int64) @ weight).T
        return out


class Block:
    """The trees of some vectors."""

    def __init__(self, forest: Forest, node: np.ndarray, vectors: np.ndarray) -> None:
        self.bits, self.node, self.vectors = forest.bits, node, vectors
        strings = forest.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.strings = np.take_along_axis(strings, self.order, 1)

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees, depths) bounds in each tree of the strings that share a prefix of 0, 1, ... bits with each of (trees, queries) strings."""
        depths = self.bits - np.arange(self.bits + 1, dtype=np.int64)
        lo, hi = (np.empty((strings.shape[1], len(strings), len(depths)), np.int64) for _ in "ab")
        for t, (tree, s) in enumerate(zip(self.strings, strings)):
            head = (s[:, None] >> depths) << depths
            lo[:, t], hi[:, t] = np.searchsorted(tree, head), np.searchsorted(tree, head + (np.int64(1) << depths))
        return lo, hi

    def best(self, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of the ``most`` nearest that the ascent finds, nearest first, ties by node."""
        n = len(self.node)
        total = (hi - lo).sum(0)  # of each depth, over all trees
        seen = np.zeros(n, bool)
        score, place = np.zeros(0), np.zeros(0, np.int64)
        depth = max(int(np.searchsorted(-total, -min(FIRST, n), "right")) - 1, 0)
        compared, unchanged_since = 0, 0
        while True:
            if total[depth] >= 2 * n or depth == 0:
                new = ~seen
            else:
                new = np.zeros(n, bool)
                for order, a, b in zip(self.order, lo[:, depth], hi[:, depth]):
                    new[order[a:b]] = True
                new &= ~seen
            seen |= new
            some = np.flatnonzero(new)
            d = self.vectors[some] - query
            d = np.sqrt((d * d).sum(1))
            compared += len(some)
            if len(some):
                at = np.concatenate((place, some))
                d = np.concatenate((score, d))
                first = np.lexsort((self.node[at], d))[:most]
                if len(first) > len(place) or (at[first] != place).any():
                    unchanged_since = compared
                score, place = d[first], at[first]
            if compared >= n or depth == 0 or (len(place) == most and compared >= GROWTH * max(unchanged_since, FIRST)):
                return score, place
            # up to where the candidates are about half as many again
            higher = np.flatnonzero(total[:depth] >= 1.5 * total[depth])
            depth = int(higher[-1]) if len(higher) else 0


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best_of_blocks(nodes: DataFrame, forest: Forest, queries: list[tuple[int, list[float]]], most: int, block: int) -> DataFrame:
    """(query, node, score): of each query the ``most`` nearest nodes that a task's blocks give."""
    names, q = np.array([n for n, _ in queries], np.int64), np.array([v for _, v in queries])

    def search(node: list[np.ndarray], vectors: list[np.ndarray], strings: np.ndarray, found: list[tuple]) -> None:
        trees = Block(forest, np.concatenate(node), np.concatenate(vectors))
        for at in range(0, len(names), 256):
            lo, hi = trees.ranges(strings[:, at : at + 256])
            for i in range(at, min(at + 256, len(names))):
                score, place = trees.best(q[i], lo[i - at], hi[i - at], most)
                score, ids = np.concatenate((found[i][0], score)), np.concatenate((found[i][1], trees.node[place]))
                first = np.lexsort((ids, score))[:most]
                found[i] = score[first], ids[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = forest.strings(q)
        found: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        node, vectors, held = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.slice(at, block)
                if held + len(part) > block:
                    search(node, vectors, strings, found)
                    node, vectors, held = [], [], 0
                node.append(part.column(0).to_numpy()), vectors.append(_matrix(part.column(1)))
                held += len(part)
        if held:
            search(node, vectors, strings, found)
        n = [len(ids) for _, ids in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(np.concatenate([ids for _, ids in found])), pa.array(np.concatenate([d for d, _ in found]))], names=["query", "node", "score"])

    return nodes.select("node", "v").mapInArrow(run, "query long, node long, score double")


def _asked(nodes: DataFrame, forest: Forest, asks: DataFrame, most: int, block: int) -> DataFrame:
    """(query, node, score) of the ``asks`` (query, qv; a staged table), about PASS of them in a pass over the nodes."""
    parts = asks.count() // PASS + 1
    out = None
    for part in range(parts):
        some = asks.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).select("query", "qv").collect()
        if some:
            one = stage(_best_of_blocks(nodes, forest, [(r["query"], r["qv"]) for r in some], most, block), "found")
            out = one if out is None else out.unionByName(one)
    return nodes.sparkSession.createDataFrame([], "query long, node long, score double") if out is None else out


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, trees: int = TREES, bits: int = BITS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, itself left out."""
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = pick(vectors), pick(queries)
    spark = vectors.sparkSession
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = rows.filter(F.size("v") == dims["d"]), asked.filter(F.size("v") == dims["d"]).distinct()
    key = F.xxhash64("v")
    nearest = rows.dropDuplicates(["id", "v"]).withColumn("h", key)
    nearest = nearest.withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).filter(F.col("r") <= k + 1)
    nodes = stage(nearest.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "v", "ids"), "nodes")
    # an id with several vectors can be the smallest of each: then vectors are told apart by a hash
    if nodes.groupBy("node").count().filter("count > 1").limit(1).count():
        nodes = stage(nodes.withColumn("node", F.xxhash64("node", "v")), "nodes")
    n = nodes.count()
    some = nodes.select("node", "v")
    if n > sample:
        some = some.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    forest = Forest(np.array([r["v"] for r in some.select("v").collect()]), trees, bits)  # about ``sample`` rows
    # ids that share a vector are asked as one and get its result
    asked = asked.withColumn("h", key)
    asks = asked.groupBy("h", F.col("v").alias("qv")).agg(F.min("id").alias("query"))
    asks = stage(asks.select(F.xxhash64("query", "qv").alias("query"), "qv"), "asked")
    sharing = stage(asked.join(asks, asked["v"] == asks["qv"]).select("query", F.col("id").alias("query_id")), "sharing")
    # the most vectors that an asked id has, all of which its own results leave out
    several = rows.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.countDistinct("v").alias("n")).agg(F.max("n")).first()[0] or 0
    most = k + max(several, 1)
    found = _asked(nodes, forest, asks, most, block)
    near = W.partitionBy("query").orderBy("score", "node")
    scored = found.withColumn("near", F.row_number().over(near)).filter(F.col("near") <= most)
    best = W.partitionBy("query_id").orderBy("score", "id")
    out = scored.join(nodes.select("node", "ids"), "node").join(sharing, "query").select("query_id", F.explode("ids").alias("id"), "score").filter("id != query_id").distinct()
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
