"""SimHash near duplicates: 64-bit fingerprints joined exactly by sharded vantage-point trees.

Two fingerprints that differ in at most RADIUS = 3 bits differ in at most one bit of one of their two halves. So there
is a tree for each half, whose nodes split fingerprints by a Hamming distance d from a vantage point, taken in the half
(where links are within 1) or in all 64 bits (where they are within 3), whichever prunes better. By the triangle
inequality a link leads from d to d - r ... d + r only, so a query descends to both sides only near the boundary.

The upper part of each tree is grown on a bounded sample; its leaves are shards. Every distinct fingerprint lives in one
shard and also visits the shards on whose boundary it lies, one way only, so each pair meets once. In a shard the tree
goes on over its members; visitors stream past it. Shards that outgrow SHARD are dealt as a grid of slots. What leaves a
task is a forest of the links found, at most one row a fingerprint, which loses no link between classes.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer than
three words are one shingle; repeated rows and rows of one id have a row each; a null id has its fingerprint and class but is
no class's smallest id (a class of null ids alone has a null one); an empty table gives no rows; other columns are not
read but for those asked for, and ``fingerprint`` and ``component_id`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import drop, free_names, stage
from ._words import chunks, lower, spans
from .components import components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Halves of a fingerprint, and how far links reach within each at most.
HALVES, NEAR = (0xFFFFFFFF, 0xFFFFFFFF << 32), RADIUS // 2
WHOLE = (1 << 64) - 1
#: Distinct fingerprints that the upper trees are grown on at most, members of a shard, and of a leaf within one.
SAMPLE, SHARD, LEAF = 100_000, 1 << 13, 128
#: Visitors that pass a shard's tree at a time, and pairs compared at once.
STREAM, TILE = 1 << 15, 1 << 20
#: Shingles of a text whose bits are counted at a time.
COUNTED = 1 << 16


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row, data, off in chunks(texts):
        data = lower(data)
        starts, ends, owner = spans(data, off)
        if not len(starts):
            continue
        raw = data.tobytes()
        at = np.searchsorted(owner, np.arange(len(off)))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if a == b:
                continue
            size = min(SHINGLE, b - a)
            n, total = b - a - size + 1, np.zeros(64, np.int64)
            for first in range(a, a + n, COUNTED):
                last = min(first + COUNTED, a + n)
                words = [raw[x:y] for x, y in zip(starts[first : last + size - 1].tolist(), ends[first : last + size - 1].tolist())]
                total += bits_of(np.array([digest(b" ".join(run), SEED) for run in zip(*(words[k : k + last - first] for k in range(size)))], np.uint64))
            out[row + i] = place[2 * total > n].sum(dtype=np.uint64)
    return out


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: int = WHOLE) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask))


class Node:
    """A split by distance from ``vantage`` under ``mask``, where links reach ``r``: at most ``mu`` is inside. A leaf has a number."""

    __slots__ = ("vantage", "mask", "r", "mu", "inside", "outside", "leaf")

    def __init__(self, leaf: int | None = None) -> None:
        self.leaf = leaf


def _split(f: np.ndarray, half: int, rng: np.random.Generator) -> tuple | None:
    """(share of pairs still to compare, vantage, mask, r, mu) of the best split found among ``f``."""
    best = None
    n = len(f)
    some = f if n <= 4096 else f[rng.integers(0, n, 4096)]
    for vantage in f[rng.integers(0, n, 3)]:
        for mask, r in ((half, NEAR), (WHOLE, RADIUS)):
            upto = np.concatenate((np.zeros(RADIUS), np.cumsum(np.bincount(distance(some, vantage, mask), minlength=65)), np.full(RADIUS, len(some)))) / len(some)
            at = np.arange(65) + RADIUS  # upto[at] is the share within each distance
            cost = upto[at + r] * upto[at] + (1 - upto[at - r]) * (1 - upto[at])
            mu = int(np.argmin(np.where((upto[at] > 0) & (upto[at] < 1), cost, 2)))
            if best is None or cost[mu] < best[0]:
                best = float(cost[mu]) if 0 < upto[mu + RADIUS] < 1 else 2.0, vantage, mask, r, mu
    return best if best[0] < 0.97 else None


def grow(f: np.ndarray, half: int, leaf: int, seed: int = 12) -> tuple[Node, int]:
    """A tree over distinct fingerprints with about ``leaf`` of them in each leaf, and how many leaves it has. Fingerprints that no split tells apart stay one leaf."""
    rng = np.random.default_rng(seed)
    root, n = Node(), 0
    left = [(root, f)]
    while left:
        node, some = left.pop()
        best = _split(some, half, rng) if len(some) > leaf else None
        if best is None:
            node.leaf, n = n, n + 1
            continue
        _, node.vantage, node.mask, node.r, node.mu = best
        near = distance(some, node.vantage, node.mask) <= node.mu
        node.leaf, node.inside, node.outside = None, Node(), Node()
        left += [(node.inside, some[near]), (node.outside, some[~near])]
    return root, n


def descend(root: Node, f: np.ndarray, members: np.ndarray, visitors: np.ndarray, visit: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """Take places of ``f`` down the tree: ``visit(leaf, members, visitors)`` once a leaf that any reach.

    A member goes to one leaf; a visitor, or a member beyond a boundary that it lies on, visits every leaf that can hold a
    fingerprint linked to it. Members visit outer sides only, so two members meet in one leaf alone.
    """
    left = [(root, members, visitors)]
    while left:
        node, m, v = left.pop()
        if not len(m) + len(v):
            continue
        if node.leaf is not None:
            visit(node.leaf, m, v)
            continue
        dm, dv = (distance(f[x], node.vantage, node.mask).astype(np.int64) for x in (m, v))
        left.append((node.inside, m[dm <= node.mu], v[dv <= node.mu + node.r]))
        left.append((node.outside, m[dm > node.mu], np.concatenate((v[dv > node.mu - node.r], m[(dm <= node.mu) & (dm > node.mu - node.r)]))))


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the places that the links a - b connect, with all that share their labels, the smallest label among them."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Shard:
    """The tree over the members of a shard, and the classes found so far."""

    def __init__(self, members: np.ndarray, half: int) -> None:
        self.f = members
        self.root, leaves = grow(members, half, LEAF)
        self.label = np.arange(len(members))
        self.at: list[np.ndarray] = [np.zeros(0, np.int64)] * leaves
        everyone = np.arange(len(members))

        def place(leaf: int, m: np.ndarray, v: np.ndarray) -> None:
            self.at[leaf] = m

        descend(self.root, members, everyone, everyone[:0], place)
        self._compare(members, self.label, everyone, everyone[:0])

    def _compare(self, f: np.ndarray, label: np.ndarray, members: np.ndarray, visitors: np.ndarray) -> None:
        """Link members with each other (where given) and with visitors, places of ``f``."""

        def visit(leaf: int, m: np.ndarray, v: np.ndarray) -> None:
            here = self.at[leaf]
            asks = np.concatenate((m, v))
            if not len(here) or not len(asks) or (label[here] == label[here[0]]).all() and (label[asks] == label[here[0]]).all():
                return
            step = max(1, TILE // len(here))
            for k in range(0, len(asks), step):
                q = asks[k : k + step]
                x, y = np.nonzero(distance(f[q][:, None], f[here][None, :]) <= RADIUS)
                settle(label, q[x], here[y])

        descend(self.root, f, members, visitors, visit)

    def pass_by(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of visitors to members, one a visitor at most, which may join members' classes."""
        n = len(self.f)
        f, label = np.concatenate((self.f, visitors)), np.concatenate((self.label, n + np.arange(len(visitors))))
        self._compare(f, label, np.zeros(0, np.int64), n + np.arange(len(visitors)))
        self.label = label[:n]
        linked = np.flatnonzero(label[n:] < n)
        return visitors[linked], self.f[label[n:][linked]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.f[some], self.f[self.label[some]]


def _signed(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _routed(prints: DataFrame, roots: list[tuple[int, Node]]) -> DataFrame:
    """(part, shard, f, visits): every fingerprint at its own shard of each part, and where it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _signed(batch.column(0))
            for part, root in roots:
                found: list[tuple[int, np.ndarray, bool]] = []

                def visit(leaf: int, m: np.ndarray, v: np.ndarray) -> None:
                    found.extend((leaf, x, k) for x, k in ((m, False), (v, True)) if len(x))

                descend(root, f, np.arange(len(f)), np.zeros(0, np.int64), visit)
                n = [len(x) for _, x, _ in found]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(n), part, np.int32)), pa.array(np.repeat([s for s, _, _ in found], n).astype(np.int32)), pa.array(f[np.concatenate([x for _, x, _ in found])].view(np.int64)), pa.array(np.repeat([k for _, _, k in found], n))], names=["part", "shard", "f", "visits"])

    return prints.select("f").mapInArrow(run, "part int, shard int, f long, visits boolean")


def _linked(units: DataFrame) -> DataFrame:
    """(a, b): links of the units (part, shard, slot, f, visits), whose members come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held = None, None, []

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            part, number, slot = (batch.column(i).to_numpy() for i in range(3))
            f, visits = _signed(batch.column(3)), batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            new = (part[1:] != part[:-1]) | (number[1:] != number[:-1]) | (slot[1:] != slot[:-1]) | (visits[1:] != visits[:-1])
            for a, b in zip([0, *(np.flatnonzero(new) + 1).tolist()], [*(np.flatnonzero(new) + 1).tolist(), len(f)]):
                unit = int(part[a]), int(number[a]), int(slot[a])
                if unit != now:
                    if held:
                        shard = Shard(np.concatenate(held), HALVES[now[0]])
                    if shard is not None:
                        yield out(*shard.forest())
                    now, shard, held = unit, None, []
                if not visits[a]:
                    held.append(f[a:b])
                    continue
                if held:
                    shard, held = Shard(np.concatenate(held), HALVES[now[0]]), []
                if shard is not None:
                    for k in range(a, b, STREAM):
                        yield out(*shard.pass_by(f[k : min(k + STREAM, b)]))
        if held:
            shard = Shard(np.concatenate(held), HALVES[now[0]])
        if shard is not None:
            yield out(*shard.forest())

    return units.select("part", "shard", "slot", "f", "visits").mapInArrow(run, "a long, b long")


def link_forest(prints: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect what all pairs of the distinct fingerprints ``f`` (a staged table) within RADIUS bits do."""
    n = prints.count()
    some = prints if n <= sample else prints.filter(F.pmod(F.xxhash64("f"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    known = np.sort(np.array([r["f"] for r in some.collect()], np.int64)).view(np.uint64)  # about ``sample`` rows
    leaf = max(32, int(shard * len(known) / max(n, 1)))
    roots = [(part, grow(known, half, leaf)[0]) for part, half in enumerate(HALVES)]
    routed = stage(_routed(prints, roots), "routed")
    # shards that outgrew their share: members in slots, each of which visits the ones before
    large = routed.filter(~F.col("visits")).groupBy("part", "shard").count().withColumn("slots", F.ceil(F.col("count") / (2 * shard)).cast("int")).filter("slots > 1")
    slots = {(r["part"], r["shard"]): r["slots"] for r in large.select("part", "shard", "slots").collect()}  # a row a shard at most
    if slots:
        table = prints.sparkSession.createDataFrame([(*k, v) for k, v in slots.items()], "part int, shard int, slots int")
        routed = routed.join(F.broadcast(table), ["part", "shard"], "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
        own = F.when(F.col("visits"), F.col("slots")).otherwise(F.pmod(F.xxhash64("f"), F.col("slots"))).cast("int")
        routed = routed.withColumn("own", own).withColumn("slot", F.explode(F.sequence(F.lit(0), F.least("own", F.col("slots") - 1))))
        routed = routed.withColumn("visits", F.col("visits") | (F.col("slot") < F.col("own")))
    else:
        routed = routed.withColumn("slot", F.lit(0))
    key = ["part", "shard", "slot"]
    return _linked(routed.repartition(*key).sortWithinPartitions(*key, "visits"))


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "fingerprint") -> DataFrame:
    """``docs`` (its columns ``keep``, all where not given) with the fingerprint as a signed long."""
    rest = [c for c in (docs.columns if keep is None else keep) if c != out]
    (own,) = free_names(docs, "text")
    wanted = docs.select(*rest, F.col(text).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fingerprints(batch.column(len(rest))).view(np.int64))], names=[*rest, out])

    return wanted.mapInArrow(run, wanted.select(*rest).schema.add(out, "long"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all where not given) with ``fingerprint`` (16 hex digits) and ``component_id``."""
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id")]
    f, lowest, c, hidden = free_names(docs.select(*rest), "f", "lowest", "c", "id")
    wanted = docs.select(*rest, F.col(doc_id).alias(hidden), F.col(text).alias(lowest))
    rows = stage(with_fingerprints(wanted, lowest, [*rest, hidden], f), "fingerprints")
    prints = stage(rows.groupBy(F.col(f).alias("f")).agg(F.min(hidden).alias("id")), "distinct")
    links = stage(link_forest(prints.select("f")), "links")
    of = components(links)
    classed = stage(prints.join(of, prints["f"] == of["node"], "left").select("f", "id", F.coalesce("component", "f").alias("c")), "classes")
    ids = classed.groupBy("c").agg(F.min("id").alias("component_id"))
    found = stage(classed.join(ids, "c").select("f", "component_id"), "found")
    drop(links), drop(prints), drop(classed)
    out = rows.withColumnRenamed(f, c).join(found, F.col(c) == F.col("f"))
    return out.select(*rest, F.lower(F.lpad(F.hex(c), 16, "0")).alias("fingerprint"), "component_id")
