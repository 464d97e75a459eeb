"""Focal operators as arrays: a raster is dealt in tiles with a halo, in one exchange, and each tile is one computation.

A pixel goes to the tile that holds it and to those in whose halo it lies, which are a few at a tile's rim. Tiles of
one shape that follow each other are computed together, so small rasters cost no call each. Pixels that are missing
are unknown, like null ones. Beyond the border of a raster stands what ``border`` says: the mirrored rows and columns
with the outermost one repeated ("mirror"), the outermost one alone ("edge"), or nothing ("none").
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
TILE = 256
#: Pixels that are computed together.
TOGETHER = 1 << 18
_PAD = {"mirror": {"mode": "symmetric"}, "edge": {"mode": "edge"}, "none": {"mode": "constant", "constant_values": np.nan}}


def extents(pixels: DataFrame) -> DataFrame:
    """(scene_id, r0, r1, c0, c1): first and last row and column of each raster."""
    return pixels.groupBy("scene_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def stencil(pixels: DataFrame, halo: int, kernel: Kernel, out: Sequence[str], values: Sequence[str] = ("v",), border: str = "mirror", tile: int = TILE, shape: tuple[int, int] | None = None) -> DataFrame:
    """scene_id, row, col and ``values`` of every pixel, with the doubles ``out``.

    kernel: from arrays (tile, row, column) of the values with the halo, to arrays without it. NaN is unknown.
    shape: rows and columns of every raster, from 0, where they are known; else they are found first.
    """
    if tile < halo:
        raise ValueError("a tile must be as large as its halo")
    values = list(values)
    p = pixels.select("scene_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(v).cast("double").alias(v) for v in values])
    if shape:
        p = p.withColumns({"r0": F.lit(0), "r1": F.lit(shape[0] - 1), "c0": F.lit(0), "c1": F.lit(shape[1] - 1)})
    else:
        p = p.join(extents(p), "scene_id")
    for name, at, lo, hi in (("tr", "row", "r0", "r1"), ("tc", "col", "c0", "c1")):
        first = F.floor(F.greatest(F.col(at) - halo, F.col(lo)) / tile)
        last = F.floor(F.least(F.col(at) + halo, F.col(hi)) / tile)
        p = p.withColumn(name, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    key = ["scene_id", "tr", "tc"]
    dealt = p.repartition(*key).sortWithinPartitions(*key)
    fields = dealt.select("scene_id", "row", "col", *values).schema
    for name in out:
        fields = fields.add(name, "double")

    def compute(t: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All tiles of a table that begin at ``start``."""
        n = np.diff(np.append(start, len(t)))
        row, col, tr, tc, r0, r1, c0, c1 = (t.column(c).to_numpy() for c in ("row", "col", "tr", "tc", "r0", "r1", "c0", "c1"))
        box = []  # of each tile: first and last row and column of its core, and how many the halo has on each side
        for at, lo, hi in ((tr, r0, r1), (tc, c0, c1)):
            a, b = np.maximum(at[start] * tile, lo[start]), np.minimum(at[start] * tile + tile - 1, hi[start])
            box += [a, b, np.minimum(halo, a - lo[start]), np.minimum(halo, hi[start] - b)]
        ra, rb, up, down, ca, cb, left, right = (x.astype(np.int64) for x in box)
        form = np.stack((rb - ra + 1, cb - ca + 1, up, down, left, right), 1)
        kinds, kind = np.unique(form, axis=0, return_inverse=True)
        kind = kind.ravel()
        for k, (h, w, u, d, lf, rt) in enumerate(kinds.tolist()):
            mine = np.flatnonzero(kind == k)
            step = max(1, TOGETHER // max(1, (h + u + d) * (w + lf + rt)))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                rows = np.repeat(start[some], n[some]) + _ranges(n[some])
                which = np.repeat(np.arange(len(some)), n[some])
                y, x = row[rows] - (ra[some] - u)[which], col[rows] - (ca[some] - lf)[which]
                arrays = {}
                for v in values:
                    a = np.full((len(some), h + u + d, w + lf + rt), np.nan)
                    a[which, y, x] = t.column(v).to_numpy(zero_copy_only=False)[rows]
                    arrays[v] = np.pad(a, ((0, 0), (halo - u, halo - d), (halo - lf, halo - rt)), **_PAD[border]) if halo else a
                with np.errstate(all="ignore"):
                    made = kernel(arrays)
                own = (y >= u) & (y < u + h) & (x >= lf) & (x < lf + w)
                rows, which, y, x = rows[own], which[own], y[own] - u, x[own] - lf
                picked = t.select(["scene_id", "row", "col", *values]).take(pa.array(rows)).combine_chunks()
                columns = [c.combine_chunks() for c in picked.columns] + [pa.array(made[c][which, y, x], from_pandas=True) for c in out]
                yield pa.RecordBatch.from_arrays(columns, names=[*picked.column_names, *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            start = _starts(t, key)
            if len(start) > 1:
                yield from compute(t.slice(0, int(start[-1])), start[:-1])
                t = t.slice(int(start[-1]))
                held, size = t.to_batches(), len(t)
        if size:
            t = pa.Table.from_batches(held)
            yield from compute(t, _starts(t, key))

    return dealt.mapInArrow(run, fields)


def grouped(compute: Callable[[pa.Table], pa.RecordBatch], key: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``compute`` over tables of whole groups, many of them at a time, for rows that are sorted by ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            last = int(_starts(t, key)[-1])  # the last group may go on
            if last:
                yield compute(t.slice(0, last))
                t = t.slice(last)
                held, size = t.to_batches(), len(t)
        if size:
            yield compute(pa.Table.from_batches(held))

    return run


def _ranges(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _starts(t: pa.Table, key: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in key:
        codes = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def box_sum(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over k x k, without the k // 2 outermost rows and columns; NaN counts as 0."""
    a = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(a), k, axis=1).sum(-1)
    return np.lib.stride_tricks.sliding_window_view(a, k, axis=2).sum(-1)


def box_mean(a: np.ndarray, k: int) -> np.ndarray:
    """Means of the known values over k x k."""
    return box_sum(a, k) / box_sum((~np.isnan(a)).astype(float), k)


def core(a: np.ndarray, halo: int) -> np.ndarray:
    return a[:, halo : a.shape[1] - halo, halo : a.shape[2] - halo]


def moments(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, variance) over k x k."""
    m = box_mean(a, k)
    return m, np.maximum(0.0, box_mean(a * a, k) - m * m)


def neighbours(a: np.ndarray) -> np.ndarray:
    """(8, tile, row, column): the neighbours of all but the outermost pixels, in row-major order."""
    h, w = a.shape[1] - 2, a.shape[2] - 2
    return np.stack([a[:, i : i + h, j : j + w] for i in range(3) for j in range(3) if (i, j) != (1, 1)])


def gaussian(a: np.ndarray, sigma: float, halo: int) -> np.ndarray:
    """A normalised Gaussian of radius int(4 sigma + 0.5), which ``halo`` must hold; NaN makes its surroundings NaN."""
    radius = min(halo, int(4 * sigma + 0.5))
    d = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * d * d / (sigma * sigma))
    w /= w.sum()
    a = core(a, halo - radius) if halo > radius else a
    h, wd = a.shape[1] - 2 * radius, a.shape[2] - 2 * radius
    a = sum(x * a[:, i : i + h] for i, x in enumerate(w))
    return sum(x * a[:, :, i : i + wd] for i, x in enumerate(w))
