"""Whole-cycle errors of unwrapped phases: between regions of a raster, and between the pairs of a pixel.

Regions are bridged along a minimum spanning forest of the shortest gaps between them. The gaps are found in tiles:
only pixels on a region's border are dealt, each to the tiles within reach, and a tile gives a row for each two regions it
sees. The reach doubles until every scene's regions are connected, or none are left to find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import stencil as st
from .hydrology import _kept as kept
from .inversion import by_pixel, threes

CELL = ["scene_id", "row", "col"]
TURN = 2 * pi
#: Pairs of places compared at once.
BLOCK = 1 << 20


def border_pixels(pixels: DataFrame) -> DataFrame:
    """(scene_id, row, col, region) of the pixels that have one of four neighbours outside their region."""

    def run(x: dict) -> dict:
        of = x["region"]
        return {"rim": (st.neighbours(of)[[1, 3, 4, 6]] != st.core(of, 1)).any(0).astype(float)}

    rims = st.stencil(pixels.select(*CELL, "region"), 1, run, ["rim"], ["region"], border="none")
    return rims.filter("rim > 0").select(*CELL, F.col("region").cast("long").alias("region"))


def _nearest(row: np.ndarray, col: np.ndarray, a: np.ndarray, na: int, b: np.ndarray, nb: int) -> tuple[np.ndarray, ...]:
    """(squared distance, place, place) of the nearest of ``na`` rows from each of ``a`` and ``nb`` rows from ``b``; of equals the first."""
    far, one, two = np.full(len(a), np.iinfo(np.int64).max), a.copy(), b.copy()
    j = b[:, None] + np.arange(nb)
    step = max(1, BLOCK // nb)
    for k in range(0, na, step):
        i = a[:, None] + np.arange(k, min(na, k + step))
        d = ((row[i][:, :, None] - row[j][:, None]) ** 2 + (col[i][:, :, None] - col[j][:, None]) ** 2).reshape(len(a), -1)
        at = d.argmin(1)
        low = d[np.arange(len(a)), at]
        new = low < far
        far[new], one[new], two[new] = low[new], (a + k + at // nb)[new], (b + at % nb)[new]
    return far, one, two


def gaps(border: DataFrame, reach: int) -> DataFrame:
    """(scene_id, a, b, far, row_a, col_a, row_b, col_b): the two nearest pixels of regions a < b within ``reach``; of equals the first in row-major order.

    Tiles are compared many at a time, and their pairs of regions that are equally large at once.
    """
    size = max(2 * reach, 128)
    tiles = lambda c, lo, hi: F.sequence(F.floor(F.greatest(F.col(c) - reach, F.col(lo)) / size).cast("int"), F.floor(F.least(F.col(c) + reach, F.col(hi)) / size).cast("int"))
    dealt = border.join(st.extents(border), "scene_id").withColumn("tr", F.explode(tiles("row", "r0", "r1"))).withColumn("tc", F.explode(tiles("col", "c0", "c1")))
    group = ["scene_id", "tr", "tc"]
    dealt = dealt.select(*group, "row", "col", F.col("region").cast("long").alias("region")).repartition(*group).sortWithinPartitions(*group)

    def compute(t: pa.Table) -> pa.RecordBatch:
        tr, tc, row, col, region = (t.column(n).to_numpy().astype(np.int64) for n in ("tr", "tc", "row", "col", "region"))
        tile = np.zeros(len(t), np.int64)
        tile[st._starts(t, group)[1:]] = 1
        tile = tile.cumsum()
        halo = (row // size != tr) | (col // size != tc)
        order = np.lexsort((col, row, halo, region, tile))
        tile, halo, row, col, region = (x[order] for x in (tile, halo, row, col, region))
        # the parts of a tile: a region's own pixels there, and those in the halo
        start = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (region[1:] != region[:-1]) | (halo[1:] != halo[:-1])))
        n = np.diff(np.append(start, len(t)))
        first = np.flatnonzero(np.append(True, tile[start][1:] != tile[start][:-1]))
        parts = np.diff(np.append(first, len(start)))
        pairs = [np.zeros((2, 0), np.int64)]
        for k in np.unique(parts):
            i, j = np.triu_indices(k, 1)
            of = first[parts == k][:, None]
            pairs.append(np.stack(((of + i).ravel(), (of + j).ravel())))
        a, b = np.concatenate(pairs, 1)
        use = (region[start[a]] != region[start[b]]) & ~(halo[start[a]] & halo[start[b]])
        a, b = a[use], b[use]
        order = np.lexsort((n[b], n[a]))
        a, b = a[order], b[order]
        kinds = np.flatnonzero(np.append(True, (np.diff(n[a]) != 0) | (np.diff(n[b]) != 0))) if len(a) else []
        found = [np.zeros((3, 0), np.int64)]
        for lo, hi in zip(kinds, [*kinds[1:], len(a)]):
            na, nb = int(n[a[lo]]), int(n[b[lo]])
            step = max(1, BLOCK // (na * nb))
            for k in range(lo, hi, step):
                found.append(np.stack(_nearest(row, col, start[a[k : min(hi, k + step)]], na, start[b[k : min(hi, k + step)]], nb)))
        far, one, two = np.concatenate(found, 1)
        far, one, two = (x[far <= reach * reach] for x in (far, one, two))
        scene = t.column("scene_id").take(pa.array(st._starts(t, group)[tile[one]])).combine_chunks()
        places = [pa.array(x.astype(np.int32)) for x in (row[one], col[one], row[two], col[two])]
        return pa.RecordBatch.from_arrays([scene, pa.array(region[one]), pa.array(region[two]), pa.array(np.sqrt(far)), *places], names=["scene_id", "a", "b", "far", "row_a", "col_a", "row_b", "col_b"])

    kind = border.schema["scene_id"].dataType.simpleString()
    found = dealt.mapInArrow(st.grouped(compute, group), f"scene_id {kind}, a long, b long, far double, row_a int, col_a int, row_b int, col_b int")
    best = F.min(F.struct("far", "row_a", "col_a", "row_b", "col_b")).alias("m")
    return found.groupBy("scene_id", "a", "b").agg(best).select("scene_id", "a", "b", "m.*")


def _joined(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning_forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges (a, b, far) of a minimum spanning forest, of each ``scene_id`` if there are several, ties by a and b."""
    parent: dict = {}
    keep = []
    edges = edges.sort_values(["far", "a", "b"])
    for s, a, b in zip(edges.get("scene_id", edges["far"] * 0), edges["a"], edges["b"]):
        x, y = _joined(parent, (s, a)), _joined(parent, (s, b))
        keep.append(x != y)
        parent[max(x, y)] = min(x, y)
    return edges[np.array(keep, bool)]


def _by_scene(edges: DataFrame, compute: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """``compute`` over the edges of whole scenes, many of them at a time."""
    run = lambda t: pa.RecordBatch.from_pandas(compute(t.to_pandas()), preserve_index=False)
    return edges.repartition("scene_id").sortWithinPartitions("scene_id").mapInArrow(st.grouped(run, ["scene_id"]), schema)


def bridges(pixels: DataFrame, farthest: int = 4096, first: int = 32) -> DataFrame:
    """The forest of each scene's regions: (scene_id, a, b, far and the two places). A scene has a few regions, whose gaps meet in a task; scenes that are connected take no part in wider searches."""
    border = kept(border_pixels(pixels))
    regions = border.groupBy("scene_id").agg(F.countDistinct("region").alias("n"))
    reach, whole = first, None
    while True:
        e = gaps(border, reach)
        tree = kept(_by_scene(e, spanning_forest, e.schema))
        short = kept(regions.join(tree.groupBy("scene_id").count(), "scene_id", "left").filter(F.col("n") - 1 > F.coalesce("count", F.lit(0))).select("scene_id"))
        last = reach >= farthest or not short.limit(1).count()
        done = tree if last else tree.join(short, "scene_id", "left_anti")
        whole = done if whole is None else whole.unionByName(done)
        if last:
            return whole
        border, regions = kept(border.join(short, "scene_id", "left_semi")), regions.join(short, "scene_id", "left_semi")
        reach *= 2


def _cycles(edges: pd.DataFrame) -> pd.DataFrame:
    """(scene_id, region, cycles) of the regions that a scene's edges (a, b, jump) connect to its root."""
    near: dict = {}
    for s, a, b, jump in zip(*(edges[c].tolist() for c in ("scene_id", "a", "b", "jump"))):
        near.setdefault((s, a), []).append(((s, b), jump))
        near.setdefault((s, b), []).append(((s, a), -jump))
    found = {x: 0 for x in zip(edges["scene_id"].tolist(), edges["root"].tolist())}
    left = list(found)
    while left:
        x = left.pop()
        for y, jump in near.get(x, ()):
            if y not in found:
                found[y] = found[x] + jump
                left.append(y)
    return pd.DataFrame({"scene_id": pd.Series([s for s, _ in found], dtype=edges["scene_id"].dtype), "region": [r for _, r in found], "cycles": list(found.values())})


def bridge_cycles(pixels: DataFrame, radius: int = 50, least_size: int = 100, reference: DataFrame | None = None, farthest: int = 4096) -> DataFrame:
    """(scene_id, region, cycles): whole cycles that bring each region of at least ``least_size`` pixels in line with its scene's reference.

    Along each bridge the medians of the two regions within ``radius`` of its ends are compared. The reference is the largest region,
    the smallest label of equals, or that of the pixel in ``reference`` (scene_id, row, col). Regions beyond ``farthest`` have no row, nor
    have pixels without a region (null or 0); a scene whose reference pixel is in no such region is left out.
    """
    p = pixels.filter("region IS NOT NULL AND region <> 0").select(*CELL, F.col("region").cast("long").alias("region"), "phase")
    sizes = kept(p.groupBy("scene_id", "region").agg(F.count("*").alias("size")).filter(F.col("size") >= least_size))
    p = p.join(sizes.select("scene_id", "region"), ["scene_id", "region"])
    if reference is None:
        root = sizes.groupBy("scene_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "region"))["region"].alias("root"))
    else:
        root = p.join(reference.select(*CELL), CELL).select("scene_id", F.col("region").alias("root"))
    tree = bridges(p, farthest)
    ends = F.array(*[F.struct(F.lit(n).alias("end"), F.col(n).alias("region"), F.col(f"row_{n}").alias("r"), F.col(f"col_{n}").alias("c")) for n in "ab"])
    windows = tree.select("scene_id", "a", "b", F.explode(ends).alias("x")).select("scene_id", "a", "b", "x.*")
    size = 2 * radius + 1
    cells = lambda c: F.sequence(F.floor((F.col(c) - radius) / size).cast("int"), F.floor((F.col(c) + radius) / size).cast("int"))
    windows = windows.withColumn("_cr", F.explode(cells("r"))).withColumn("_cc", F.explode(cells("c")))
    held = p.withColumns({"_cr": F.floor(F.col("row") / size).cast("int"), "_cc": F.floor(F.col("col") / size).cast("int")})
    seen = held.join(windows, ["scene_id", "region", "_cr", "_cc"]).filter((F.abs(F.col("row") - F.col("r")) <= radius) & (F.abs(F.col("col") - F.col("c")) <= radius))
    medians = seen.groupBy("scene_id", "a", "b").agg(*[F.percentile(F.when(F.col("end") == n, F.col("phase")), F.lit(0.5)).alias(f"m{n}") for n in "ab"])  # of two windows
    jumps = medians.select("scene_id", "a", "b", F.rint((F.col("ma") - F.col("mb")) / TURN).cast("long").alias("jump"))
    alone = root.select("scene_id", F.col("root").alias("a"), F.col("root").alias("b"), F.lit(0).cast("long").alias("jump"))
    edges = jumps.filter("jump IS NOT NULL").unionByName(alone).join(root, "scene_id")
    return _by_scene(edges, _cycles, "scene_id long, region long, cycles long")


def bridged(pixels: DataFrame, **how) -> DataFrame:
    """``pixels`` (scene_id, row, col, phase, region) with ``bridged``, the phase after the regions' whole cycles, where they are known."""
    c = bridge_cycles(pixels, **how)
    joined = pixels.withColumn("_r", F.col("region").cast("long")).join(c.select("scene_id", F.col("region").alias("_r"), "cycles"), ["scene_id", "_r"], "left")
    return joined.select(*pixels.columns, (F.col("phase") + F.coalesce("cycles", F.lit(0)) * TURN).alias("bridged"))


def triangles(first: np.ndarray, second: np.ndarray, pixel: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the list of pairs, and signs, of (a, b), (b, c) and (a, c) for each three dates that a pixel's pairs join; of a pair given twice the first counts."""
    pixel = np.zeros(len(first), np.int64) if pixel is None else pixel
    order = np.lexsort((np.arange(len(first)), second, first, pixel))
    p, a, b = pixel[order], first[order], second[order]
    once = order[np.append(True, (p[1:] != p[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]]
    found = threes(pixel[once], first[once], second[once])
    return np.stack([once[x] for x in found], 1).astype(np.int64), np.array([1, 1, -1])


def whole_cycles(first: np.ndarray, second: np.ndarray, phase: np.ndarray, coherence: np.ndarray, pixel: np.ndarray | None = None) -> np.ndarray:
    """Cycles to add to each pair's phase so that triangles close; pixels are numbers from 0, and all are taken a step further at once.

    The pair of a pixel whose change by a cycle closes the most of what is open is changed, the least coherent of equals, until no change helps.
    """
    n = len(phase)
    out = np.zeros(n, np.int64)
    pixel = np.zeros(n, np.int64) if pixel is None else pixel
    t, signs = triangles(first, second, pixel)
    off = np.rint((phase[t] * signs).sum(1) / TURN).astype(np.int64)
    bad = np.unique(pixel[t[off != 0, 0]])
    keep = np.isin(pixel[t[:, 0]], bad)
    t, off = t[keep], off[keep]
    s = np.tile(signs, (len(t), 1))
    # a pair from a date to itself: what stands on both sides does not count
    i, j, k = t.T
    s[(j == k) & (i != k), 1:] = 0
    s[(i == k) & (j != k), ::2] = 0
    s[(i == j) & (j == k), 1:] = 0
    order = np.lexsort((np.arange(n), coherence, pixel))
    order = order[np.isin(pixel[order], bad)]
    while len(t):
        gains = [np.bincount(t.ravel(), (np.abs(off)[:, None] - np.abs(off[:, None] + g * s)).ravel(), n) for g in (1, -1)]
        best = np.maximum(*gains)[order]
        start = np.flatnonzero(np.append(True, np.diff(pixel[order]) != 0))
        most = np.repeat(np.maximum.reduceat(best, start), np.diff(np.append(start, len(order))))
        at = np.flatnonzero((best == most) & (most > 0))
        pair = order[at[np.unique(pixel[order[at]], return_index=True)[1]]]
        change = np.zeros(n, np.int64)
        change[pair] = np.where(gains[0][pair] >= gains[1][pair], 1, -1)
        out += change
        on = np.isin(pixel[t[:, 0]], pixel[pair])
        t, s, off = t[on], s[on], off[on]
        off = off + (change[t] * s).sum(1)
        order = order[np.isin(pixel[order], pixel[pair])]
    return out


def closing_cycles(ifg: DataFrame, pixel: str = "pixel") -> DataFrame:
    """(pixel, d1, d2, cycles): whole cycles to add to the phases of ``ifg`` (pixel, d1, d2, phase, coherence), of the pairs that need any.

    Rows without a pixel, a phase or a date take no part; of a pair given twice the first in order counts. A pixel has a bounded number of pairs.
    """
    values = [F.col("phase").cast("double").alias("phase"), F.coalesce(F.col("coherence").cast("double"), F.lit(0.0)).alias("coherence")]
    used = ifg.select(pixel, "d1", "d2", *values).dropna(subset=[pixel, "d1", "d2", "phase"])
    kinds = [used.schema[n].dataType.simpleString() for n in (pixel, "d1", "d2")]

    def compute(t: pa.Table) -> pa.RecordBatch:
        own = np.zeros(len(t), np.int64)
        own[st._starts(t, [pixel])[1:]] = 1
        cycles = whole_cycles(*(t.column(n).to_numpy() for n in ("d1", "d2", "phase", "coherence")), own.cumsum())
        some = pa.array(np.flatnonzero(cycles))
        columns = [t.column(n).take(some).combine_chunks() for n in (pixel, "d1", "d2")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(cycles[np.flatnonzero(cycles)])], names=[pixel, "d1", "d2", "cycles"])

    schema = f"{pixel} {kinds[0]}, d1 {kinds[1]}, d2 {kinds[2]}, cycles long"
    return by_pixel(used, pixel, "d1", "d2", "phase", "coherence").mapInArrow(st.grouped(compute, [pixel]), schema)


def closed(ifg: DataFrame, pixel: str = "pixel") -> DataFrame:
    """``ifg`` with ``closed``, the phase after the whole cycles that close triangles."""
    c = closing_cycles(ifg, pixel)
    return ifg.join(c, [pixel, "d1", "d2"], "left").select(*ifg.columns, (F.col("phase") + F.coalesce("cycles", F.lit(0)) * TURN).alias("closed"))
