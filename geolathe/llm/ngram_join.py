"""Exact Jaccard join of whole texts on word shingles through a token-group matrix.

1. One pass over the texts gives each text's set size, its minhashes and a 128-bit fingerprint of its set (equal sets
   are one class, whose representative is its smallest id) and finds shingles that many texts share.
2. Classes that agree in several minhashes are compared with a leader; what is linked so is one group, named by its
   smallest id. A class without such a link is a group of its own. This only makes the matrix small: links that it
   misses are found by the steps below.
3. A second pass orders each set by (shared by many, hash) and keeps its prefix: the size - need + MATCHES first
   shingles, where need is the least overlap that the threshold allows. Two linked sets have MATCHES shingles of their
   prefixes in common, whatever the common order is, and each of them stands so early that enough shingles follow it.
4. The matrix has a row for each (shingle, group): the union of its members' prefixes, reduced in each task before it
   is shuffled, with the least and greatest size of the members that have the shingle and the most shingles that
   follow it in one of them. Pairs of groups are counted that share MATCHES shingles which these bounds allow. Of shingles
   at the end of the order, which many texts share, a prefix has only those that can be the first common one of two linked
   sets, with all of the overlap behind it; what a text leaves out is counted in favour of its pairs. So texts that only
   have a form's words in common, too few to link, never meet.
5. Of each such pair the leaders are compared. Where the two are not in one component then, the smaller group's texts
   ask the larger one's blocks: the union of a block's sets bounds the overlap, and only blocks that can reach the
   threshold are opened and compared in full.

No pair is lost: steps 3 and 4 are exact filters, and step 5 only skips pairs that are already connected. A task
holds a bounded number of prefixes or one bucket of the matrix, in which a group counts once, however large it is.

Defined results: null or empty texts have an empty set and no links; a null id takes part in no link and gets a
null component; repeated rows of one id are one node, linked if any of them is; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import SLIM_ROWS, drop, free_names, running_before, small, stage
from ._words import chunks, mix, shingle_sets
from .components import components

K = 5
PERCENT = 80
#: Sets that link without being equal have at least so many shingles, at 80 percent: 4 of 5.
MATCHES = 3
#: A shingle that more texts than this have goes to the end of the common order.
SHARED = 64
#: A shingle is counted as soon as so many texts of one chunk have it.
SUSPECT = 3
#: At most so many shingles are told to all tasks; beyond, the counts that they must exceed are doubled. Any order is exact.
TOLD = 1_000_000
#: Entries that a bucket of the matrix has on average.
BUCKET = 400_000
#: A shingle in more groups than this is put at the end of the order, and the matrix is made again.
CROWD = 512
#: Sets that are opened together, and shingles that these have together on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Entries of prefixes that are dealt to buckets at a time, and pairs of groups that are looked at together.
ENTRIES, PAIRS = 1_000_000, 1 << 19
MET, HEAVY = 1, 2

#: Minhashes of a set; a class is compared with that leader of its first LEADS ones with which it agrees best, in AGREE of all at least.
HASHES, LEADS, AGREE = 10, 5, 5
_TURN = np.random.default_rng(5).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SETS = "doc_id long, n_shingles long, sig_a long, sig_b long, low binary"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _overlap(n, percent: int):
    """The least overlap of two linked sets that have ``n`` shingles together."""
    return -(-percent * n // (100 + percent))


def survey(docs: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(sets, suspects): a row for each text, and (shingle, n) of shingles that several texts of a chunk have."""
    names = ["doc_id", "n_shingles", "sig_a", "sig_b", "low", "suspect"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, off in chunks(batch.column(1), 16 << 20):
                n, a, b, low, sets = [], [], [], [], {}
                for s in (s for lo in _pieces(data, off) for s in shingle_sets(*lo, k)):
                    x, y = (int(np.add.reduce(s)), int(np.add.reduce(mix(s)))) if len(s) else (0, 0)
                    n.append(len(s)), a.append(x), b.append(y)
                    low.append(np.array([(s * c).min() for c in _TURN]).tobytes() if len(s) else None)
                    sets[x, y] = s  # equal texts count once
                t = np.sort(np.concatenate(list(sets.values()))) if sets else np.zeros(0, np.uint64)
                edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
                runs = np.diff(np.append(edge, len(t)))
                many = runs >= SUSPECT
                t, runs = t[edge[many]], runs[many]
                nulls = pa.nulls(len(t), pa.int64())
                own = [ids.slice(row, len(n)), pa.array(n, pa.int64()), _signed(np.array(a, np.uint64)), _signed(np.array(b, np.uint64)), pa.array(low, pa.binary()), pa.array(np.zeros(len(n), bool), pa.bool_())]
                yield pa.RecordBatch.from_arrays(own, names=names)
                yield pa.RecordBatch.from_arrays([nulls, pa.array(runs, pa.int64()), _signed(t), nulls, pa.nulls(len(t), pa.binary()), pa.array(np.ones(len(t), bool), pa.bool_())], names=names)

    found = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SETS + ", suspect boolean"), "sets")
    sets = found.filter(~F.col("suspect")).drop("suspect")
    return sets, found.filter("suspect").select(F.col("sig_a").alias("shingle"), F.col("n_shingles").alias("n"))


def _told(counts: DataFrame, least: int) -> np.ndarray:
    """The shingles counted more often than ``least``, or a multiple of it that at most TOLD exceed."""
    while counts.filter(F.col("n") > least).limit(TOLD + 1).count() > TOLD:
        least *= 2
    at = counts.filter(F.col("n") > least).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(at.view(np.uint64))


def _keys(s: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower half of shingles in one number: the form in which the matrix holds them."""
    return (((s >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``some``."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _prefix(s: np.ndarray, shared: np.ndarray, buckets: int, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles in the common order, without the shared ones that cannot be the first common one, and how many shared ones there were, MATCHES - 1 at most."""
    first = len(s) - _needed(len(s), percent) + 1
    late = _among(_keys(s, buckets), shared)
    early = len(s) - int(late.sum())
    p = first + MATCHES - 1
    if early >= p:
        return s[~late][:p], 0
    return np.concatenate((s[~late], s[late]))[: max(first, early)], min(MATCHES - 1, min(p, len(s)) - early)


def _prefixes(docs: DataFrame, shared: np.ndarray, buckets: int, k: int, percent: int) -> DataFrame:
    """(doc_id, size, late, low, bucket): of each text with an id and MATCHES shingles, the size of its set, the shared shingles and the lower halves and buckets of its prefix."""
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in chunks(batch.column(1), 16 << 20):
                doc, full, shares, low, bucket = [], [], [], [], []
                for one, s in zip(batch.column(0).slice(row, len(off) - 1).to_pylist(), (s for lo in _pieces(data, off) for s in shingle_sets(*lo, k))):
                    if one is not None and len(s) >= MATCHES:
                        t, late = _prefix(s, shared, buckets, percent)
                        doc.append(one), full.append(len(s)), shares.append(late)
                        low.append(t.astype(np.uint32).tobytes()), bucket.append(((t >> np.uint64(32)) % np.uint64(buckets)).astype(width).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(full, pa.int64()), pa.array(shares, pa.int32()), pa.array(low, pa.binary()), pa.array(bucket, pa.binary())], names=["doc_id", "size", "late", "low", "bucket"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, late int, low binary, bucket binary")


def _width(buckets: int) -> type:
    return np.uint8 if buckets <= 1 << 8 else np.uint16 if buckets <= 1 << 16 else np.uint32


def _packed(x: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones, compressed."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = pa.decompress(x, n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(width, n).T).view(kind).ravel()


def _reduced(order: np.ndarray, same: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, *most: np.ndarray) -> tuple:
    """The entries in ``order``, those that agree in ``same`` made one with the least ``lo`` and the greatest of the others."""
    same = [x[order] for x in same]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
    at = np.flatnonzero(first)
    if not len(at):
        return *same, lo, hi, *most
    return *(x[at] for x in same), np.minimum.reduceat(lo[order], at), *(np.maximum.reduceat(x[order], at) for x in (hi, *most))


def _blocks(prefixes: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, n, shingles, groups, sizes, spans, rests, lates) of prefixes with their group: entries (shingle, group) of a bucket as arrays.

    Within a bucket entries are in order of their groups, whose numbers are given as differences; all but the
    shingles are compressed.
    """
    width = _width(buckets)
    names = ["bucket", "n", "shingles", "groups", "sizes", "spans", "rests", "lates"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full, group, shares = (batch.column(c).to_numpy() for c in ("size", "g", "late"))
            lows, codes = batch.column("low"), batch.column("bucket")
            rank = np.argsort(group, kind="stable")
            n = np.array([len(x.as_buffer()) for x in codes], np.int64)[rank] // np.dtype(width).itemsize
            sums = np.cumsum(n)
            at = 0
            while at < len(rank):
                end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + ENTRIES, "right")))
                some, m = rank[at:end], n[at:end]
                at = end
                low = np.frombuffer(b"".join(lows[int(i)].as_buffer() for i in some), np.uint32)
                bucket = np.frombuffer(b"".join(codes[int(i)].as_buffer() for i in some), width)
                size = np.repeat(full[some].astype(np.uint32), m)
                rest = size - _ranges(m).astype(np.uint32)
                g = np.repeat(group[some], m)
                late = np.repeat(shares[some].astype(np.uint8), m)
                bucket, g, low, lo, hi, rest, late = _reduced(np.lexsort((low, g, bucket)), [bucket, g, low], size, size, rest, late)
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                spans = list(zip(cut, np.append(cut[1:], len(bucket))))
                columns = [[low[a:b].tobytes() for a, b in spans], [_packed(np.diff(g[a:b], prepend=np.int64(0))) for a, b in spans], *([_packed(x[a:b]) for a, b in spans] for x in (lo, hi - lo, rest, late))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int64)), pa.array([int(b - a) for a, b in spans], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    return prefixes.mapInArrow(run, "bucket long, n long, shingles binary, groups binary, sizes binary, spans binary, rests binary, lates binary")


def _entries(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(lower halves, groups, least sizes, greatest sizes, rests, shared ones) of a bucket, one for each shingle and group, in their order."""
    out = []
    for n, low, g, z, w, r, c in zip(*(table.column(c).to_pylist() for c in ("n", "shingles", "groups", "sizes", "spans", "rests", "lates"))):
        lo = _unpacked(z, np.uint32, n)
        out.append((np.frombuffer(low, np.uint32), np.cumsum(_unpacked(g, np.int64, n)), lo, lo + _unpacked(w, np.uint32, n), _unpacked(r, np.uint32, n), _unpacked(c, np.uint8, n)))
    t, g, lo, hi, rest, late = (np.concatenate(x) for x in zip(*out))
    return _reduced(np.lexsort((g, t)), [t, g], lo, hi, rest, late)


def _pieces(data: np.ndarray, off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    row = 0
    while row < len(off) - 1:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def meet(t: np.ndarray, g: np.ndarray, lo: np.ndarray, hi: np.ndarray, rest: np.ndarray, percent: int, late: np.ndarray | None = None, shared: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group, other) for each shingle that can be among the first MATCHES common ones of two of their members, the smaller number first.

    Of two linked sets the smaller one, and of two equal ones either, has such a shingle within the part of its
    prefix after which 2 * percent / (100 + percent) of its size follow: only such entries look for others. At a
    ``shared`` shingle (told for each entry) two meet only if it can be the first of all that they have in common. A pair
    that can be so counts again for each of the shared shingles, ``late``, that both may have left out.
    """
    late = np.zeros(len(t), np.int64) if late is None else late.astype(np.int64)
    more = np.full(len(t), MATCHES - 1) if shared is None else np.where(shared, 0, MATCHES - 1)
    new = np.concatenate(([True], t[1:] != t[:-1]))
    start = np.flatnonzero(new)
    groups = np.diff(np.append(start, len(t)))
    token = np.cumsum(new) - 1
    lo, hi, rest = (x.astype(np.int64) for x in (lo, hi, rest))
    asks = np.flatnonzero((groups[token] > 1) & (rest + more >= _overlap(2 * lo, percent)))
    wide = groups[token[asks]]
    cost = np.cumsum(wide)
    at = 0
    while at < len(asks):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        left, n = asks[at:end], wide[at:end]
        at = end
        right = np.repeat(start[token[left]], n) + _ranges(n)
        left = np.repeat(left, n)
        # the least sizes that members of both can have and link
        a = np.maximum(lo[left], -(-percent * lo[right] // 100))
        b = np.maximum(lo[right], -(-percent * lo[left] // 100))
        least, behind = _overlap(a + b, percent), np.minimum(rest[left], rest[right])
        fits = (left != right) & (a <= hi[left]) & (b <= hi[right]) & (behind + more[left] >= least)
        # a pair of two that both ask is seen from both sides
        fits &= (left < right) | (rest[right] + more[right] < _overlap(2 * lo[right], percent))
        left, right = left[fits], right[fits]
        times = 1 + np.where(behind[fits] >= least[fits], np.minimum(late[left], late[right]), 0)
        left, right = np.repeat(left, times), np.repeat(right, times)
        yield np.minimum(g[left], g[right]), np.maximum(g[left], g[right])


def _meetings(blocks: DataFrame, shared: np.ndarray, percent: int, crowd: int) -> DataFrame:
    """Rows (kind, a, b, n) of the matrix, bucket by bucket.

    MET: two groups and how many shingles they share that their bounds allow. HEAVY: bucket and lower half of a
    shingle that is in more than ``crowd`` groups and not yet at the end of the order; the matrix is then made
    again, so a bucket that has one gives no meetings.
    """

    def rows_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, b, n))], names=["kind", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        bucket = table.column("bucket")[0].as_py()
        t, g, lo, hi, rest, late = _entries(table)
        del table
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        groups = np.diff(np.append(start, len(t)))
        known = _among((np.uint64(bucket) << np.uint64(32)) | t[start].astype(np.uint64), shared)
        heavy = t[start[(groups > crowd) & ~known]]
        if len(heavy):
            yield rows_of(HEAVY, np.full(len(heavy), bucket), heavy, np.ones(len(heavy)))
            return
        yield rows_of(MET, *(np.zeros(0),) * 3)
        held: list[tuple] = []
        for a, b in meet(t, g, lo, hi, rest, percent, late, np.repeat(known, groups)):
            held.append(_counted([*held, (a, b, np.ones(len(a), np.int64))]))
            del held[:-1]
            if len(held[0][0]) > 4 * PAIRS:
                yield rows_of(MET, *held.pop())
        if held:
            yield rows_of(MET, *held.pop())

    return blocks.groupBy("bucket").applyInArrow(run, "kind int, a long, b long, n long")


def _counted(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) rows with equal pairs made one."""
    a, b, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    if not len(a):
        return a, b, n
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[at], b[at], np.add.reduceat(n, at)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n."""
    sizes = np.asarray(sizes, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in chunks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(data, off, k)]
                ends = np.cumsum([0, *map(len, sets)])
                values = pa.array(np.concatenate(sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc", "shingles"])

    return docs.mapInArrow(run, "doc long, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    n = F.size("x.shingles") + F.size("y.shingles")
    fits = (100 * F.least(F.size("x.shingles"), F.size("y.shingles"))) >= percent * F.greatest(F.size("x.shingles"), F.size("y.shingles"))
    j = pairs.alias("p").join(sets.alias("x"), F.col("p.a") == F.col("x.doc")).join(sets.alias("y"), F.col("p.b") == F.col("y.doc")).filter(fits)
    both = F.size(F.array_intersect("x.shingles", "y.shingles"))
    return j.filter(100 * both >= percent * (n - both)).select("p.a", "p.b")


def _compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b; a staged table)."""
    sets = _sets_of(docs, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), k)
    links = stage(_linked(pairs, sets, percent).distinct(), "links")
    drop(sets)
    return links


def _labels(edges: DataFrame) -> DataFrame:
    return stage(components(edges), "labels")


def _labelled(df: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    lab = labels.select(F.col("node").alias(col), F.col("component").alias("_c"))
    return df.join(lab, col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")


def matrix(docs: DataFrame, members: DataFrame, shared: np.ndarray, buckets: int, k: int = K, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """(kind, a, b, n) of the token-group matrix of the texts in ``members`` (doc, g), made again until every crowded shingle is at the end of the order.

    The prefixes are shuffled to the groups, not the texts; the plan is the same at every size.
    """
    while True:
        own = _prefixes(docs, shared, buckets, k, percent).join(members.select("doc", "g").hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).drop("doc")
        met = stage(_meetings(_blocks(own, buckets), shared, percent, crowd), "meetings")
        heavy = met.filter(F.col("kind") == HEAVY).select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("key")).limit(TOLD + 1).toPandas()["key"].to_numpy(np.int64)
        if not len(heavy):
            return met
        more = np.unique(np.concatenate((shared, heavy.view(np.uint64))))
        if len(more) > 2 * TOLD:
            crowd *= 2
        else:
            shared = more


def _first_links(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between a class and, of the smallest ids that share one of its LEADS minhashes, the one that it agrees with best, as far as they hold."""
    part = lambda i: F.substring("low", 8 * i + 1, 8)
    keyed = classes.filter(F.col("n_shingles") > MATCHES).select("rep", "low", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(i).alias("h")) for i in range(LEADS)])).alias("x")).select("rep", "low", "x.i", "x.h")
    lead = keyed.groupBy("i", "h").agg(F.min(F.struct("rep", "low")).alias("lead"), F.count("*").alias("n")).filter("n > 1")
    agree = sum(((F.substring("low", 8 * i + 1, 8) == F.substring("lead.low", 8 * i + 1, 8)).cast("int") for i in range(HASHES)), F.lit(0))
    pairs = keyed.join(lead.drop("n"), ["i", "h"]).filter(F.col("rep") != F.col("lead.rep")).select(F.col("rep").alias("a"), F.col("lead.rep").alias("b"), agree.alias("agree")).filter(F.col("agree") >= AGREE)
    best = pairs.groupBy("a").agg(F.max(F.struct(F.col("agree"), (-F.col("b")).alias("b"))).alias("best"))
    return _compared(stage(best.select("a", (-F.col("best.b")).alias("b")), "pairs"), docs, k, percent)


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, shingles) of the texts with these ids (one column)."""
    ids = stage(ids.toDF("_id").distinct(), "ids")  # of a table of its own, whose columns are doc_id and text
    return stage(_full_sets(docs.join(small(ids, SLIM_ROWS), F.col("doc_id") == F.col("_id"), "left_semi"), k), "members", "lz4")


def _candidate_links(docs: DataFrame, classes: DataFrame, shared: np.ndarray, buckets: int, k: int, percent: int) -> DataFrame:
    """(a, b) links between classes, enough of them to connect whatever the threshold connects."""
    edges = _first_links(classes, docs, k, percent)
    sizes = classes.groupBy(F.col("rep").alias("doc")).agg(F.min("n_shingles").alias("size"))
    members = stage(_labelled(sizes, _labels(edges), "doc", "g"), "members")
    met = matrix(docs, members, shared, buckets, k, percent)
    asks = stage(met.filter(F.col("kind") == MET).groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= MATCHES).select("a", "b"), "qualifying")
    if not asks.limit(1).count():
        return edges
    # first the leaders of the groups, by which groups are named
    edges = stage(edges.unionByName(_compared(asks, docs, k, percent)), "links")
    labels = _labels(edges)

    count = stage(members.groupBy("g").agg(F.count("*").alias("n"), F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES).alias("blocks")).filter("n > 1"), "groups")
    rest = _labelled(_labelled(asks, labels, "a", "ca"), labels, "b", "cb").filter("ca != cb")
    number = lambda c: count.select(F.col("g").alias(c), F.col("n").alias(f"n{c}"))
    rest = rest.join(number("a"), "a", "left").join(number("b"), "b", "left").filter("na IS NOT NULL OR nb IS NOT NULL")
    turned = F.coalesce("na", F.lit(1)) > F.coalesce("nb", F.lit(1))
    rest = stage(rest.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("asker"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("g")), "unsettled")
    if not rest.limit(1).count():
        return edges
    asked = members.join(rest.select("g").distinct(), "g", "left_semi").join(count, "g")
    inside = stage(asked.select("g", F.pmod(F.xxhash64("doc"), F.ceil("blocks")).alias("block"), F.col("doc").alias("b"), "size"), "inside")
    queries = stage(rest.join(members.select(F.col("g").alias("asker"), "doc", "size"), "asker").select("doc", "size", "g").distinct(), "queries")
    sets = _sets_of(docs, inside.select("b").unionByName(queries.select(F.col("doc").alias("b"))), k)
    blocks = inside.join(sets, F.col("b") == F.col("doc")).groupBy("g", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("union"))
    blocks = stage(blocks, "blocks", "lz4")
    tight = stage(queries.join(blocks.drop("union"), "g").filter((100 * F.col("hi") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("lo"))).select("doc", "g", "block"), "tight")
    least = F.ceil(percent * (F.size("shingles") + F.greatest(F.col("lo"), F.ceil(percent * F.size("shingles") / 100))) / (100 + percent))
    opened = tight.join(sets, "doc").join(blocks, ["g", "block"]).filter(F.size(F.array_intersect("union", "shingles")) >= least).select(F.col("doc").alias("a"), "g", "block").distinct()
    pairs = stage(opened, "opened").join(inside, ["g", "block"]).filter("a != b").select("a", "b").distinct()
    return edges.unionByName(stage(_linked(stage(pairs, "pairs"), sets, percent).distinct(), "links"))


def join_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; percent: 80 or more."""
    if percent < 80:
        raise ValueError("sets of fewer than MATCHES common shingles could link below 80 percent")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets, suspects = survey(docs, k)
    same = ["n_shingles", "sig_a", "sig_b"]
    known = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("low").alias("low")), "classes")
    prefixes = classes.agg(F.sum((F.col("n_shingles") * (100 - percent) / 100).cast("long") + MATCHES)).first()[0] or 0
    buckets = max(16, int(prefixes // BUCKET) + 1)
    shared = np.unique(_keys(_told(stage(suspects.groupBy("shingle").agg(F.sum("n").alias("n")), "suspects"), SHARED), buckets))
    edges = _candidate_links(docs, classes, shared, buckets, k, percent)
    # ids that have several texts connect their classes
    several = stage(known.select("doc_id", *same).distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    if several.limit(1).count():
        own = known.join(several, "doc_id", "left_semi").join(classes.drop("low"), same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        edges = edges.unionByName(own)
    labels = _labels(edges)
    named = classes.drop("low").join(labels, F.col("rep") == F.col("node"), "left")
    out = sets.drop("low").join(named, same, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, one of its smallest id; rows without an id or a component stay."""
    own = F.col(doc_id).cast("long")
    gone, key, row, one, number = free_names(docs, "gone", "id", "row", "one", "number")
    repeated = docs.filter(own.isNotNull()).groupBy(own.alias(key)).count().filter("count > 1").limit(1).count()
    dropped = lambda groups: small(stage(groups.filter("component_id != doc_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped"), SLIM_ROWS)
    if not repeated:
        return docs.join(dropped(join_groups(docs, doc_id, text)), own == F.col(gone), "left_anti")
    # where ids are repeated, rows are joined by their number in the order of the ids
    rows = stage(docs.withColumns({key: own, row: F.monotonically_increasing_id(), one: F.lit(1)}), "rows")
    slim = stage(running_before(rows.filter(F.col(key).isNotNull()).select(key, row, one), one, [key, row], out=number).select(row, number), "numbers")
    rows = stage(rows.join(slim, row, "left").drop(row, key, one), "rows")
    return rows.join(dropped(join_groups(rows, number, text)), F.col(number) == F.col(gone), "left_anti").select(*docs.columns)
