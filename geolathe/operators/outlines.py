"""Outlines of regions as rings of corners, holes included, whatever tiles they run through.

Each side of a cell whose neighbour is of another region is an edge that knows the next edge of its ring from the cells
around it. Edges are linked to chains in one tile at a time, and only chains that leave their tile go on to the next,
wider tiles: a linked list may be shortened in any of its parts. Places along a ring come back down the same steps, so
no task holds a ring's corners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hydrology
from . import stencil as st

#: Bits of a column in the key of an edge; two more tell the side.
COL_BITS = 28
#: Sides in their order around a cell, the cell to the right of the way: top, right, bottom, left.
_AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
_OUT = ((-1, 0), (0, 1), (1, 0), (0, -1))
_TURN, _STRAIGHT, _BACK = 1, 2, 3


def _key(row: Column, col: Column, side: Column) -> Column:
    return (row.cast("long") * (1 << COL_BITS) + col) * 4 + side


def edges(regions: DataFrame) -> DataFrame:
    """(scene_id, region, value, key, next, side, row, col, corner): the sides of all cells that face another region or nothing.

    ``regions``: (scene_id, row, col, value, region), rows and columns from 0 and columns below 2^28. Cells that touch at
    a corner alone are not connected, so a way turns to stay with its cell. ``corner``: the ring bends at the edge's end.
    """

    def run(x: dict) -> dict:
        of = x["region"]
        here = st.core(of, 1)
        near = st.neighbours(of)  # in row-major order without the centre
        at = {(i, j): n for n, (i, j) in enumerate((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))}
        same = near == here
        code = np.zeros(here.shape)
        for side in range(4):
            (ar, ac), (orow, ocol) = _AHEAD[side], _OUT[side]
            way = np.where(~same[at[ar, ac]], _TURN, np.where(~same[at[ar + orow, ac + ocol]], _STRAIGHT, _BACK))
            code += np.where(same[at[orow, ocol]], 0, way) * 4.0**side
        return {"code": code}

    p = st.stencil(regions.select("scene_id", "row", "col", "region", "value"), 1, run, ["code"], ["region", "value"], border="none")
    e = p.filter("code > 0").withColumn("side", F.explode(F.array(*map(F.lit, range(4)))))
    code = F.col("code").cast("int")
    way = F.element_at(F.array(*[F.shiftright(code, 2 * s).bitwiseAND(3) for s in range(4)]), F.col("side") + 1)
    e = e.withColumn("_way", way).filter("_way > 0")
    step = lambda d, i: F.element_at(F.array(*[F.lit(v[i]) for v in d]), F.col("side") + 1)
    far, out = F.col("_way") >= _STRAIGHT, F.col("_way") == _BACK
    row = F.col("row") + F.when(far, step(_AHEAD, 0)).otherwise(0) + F.when(out, step(_OUT, 0)).otherwise(0)
    col = F.col("col") + F.when(far, step(_AHEAD, 1)).otherwise(0) + F.when(out, step(_OUT, 1)).otherwise(0)
    turned = F.pmod(F.col("side") + F.when(F.col("_way") == _TURN, 1).when(out, -1).otherwise(0), F.lit(4))
    return e.select(
        "scene_id", F.col("region").cast("long").alias("region"), F.col("value").cast("long").alias("value"), _key(F.col("row"), F.col("col"), F.col("side")).alias("key"),
        _key(row, col, turned).alias("next"), "side", "row", "col", (F.col("_way") != _STRAIGHT).alias("corner"),
    )


def _before(pred: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, sum of sizes before) along ``pred``, -1 at the start of a chain; ``first`` is -1 on cycles."""
    first, ahead = np.where(pred < 0, np.arange(len(pred)), -1), pred.copy()
    total = np.where(pred < 0, 0, size[np.maximum(pred, 0)])
    for _ in range(max(1, int(np.ceil(np.log2(len(pred) + 1))))):
        live = ahead >= 0
        if not live.any():
            break
        to = ahead[live]
        first[live] = first[to]
        total[live] += total[to]
        ahead[live] = ahead[to]
    first[ahead >= 0] = -1
    return first, total


def contracted(scene: np.ndarray, key: np.ndarray, after: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(head, at, next, size) of chains: of each its head's key and the sizes before it there; for heads, where the whole
    chain leads and its size. ``next`` is -1 for a closed chain, whose head has its smallest key, and for those that are no heads."""
    place = pd.MultiIndex.from_arrays([scene, key])
    succ = place.get_indexer(pd.MultiIndex.from_arrays([scene, after]))
    pred = np.full(len(key), -1)
    pred[succ[succ >= 0]] = np.flatnonzero(succ >= 0)
    first, total = _before(pred, size)
    round_ = first < 0
    if round_.any():  # closed: cut before the smallest key
        low, ahead = key.copy(), pred.copy()
        for _ in range(int(np.ceil(np.log2(len(key) + 1))) + 1):
            low[round_] = np.minimum(low[round_], low[ahead[round_]])
            ahead[round_] = ahead[ahead[round_]]
        cut = round_ & (low == key)
        succ[pred[cut]] = -1
        pred[cut] = -1
        first, total = _before(pred, size)
    last = np.flatnonzero(succ < 0)
    onward, whole = np.full(len(key), -1), np.zeros(len(key), np.int64)
    onward[first[last]] = np.where(round_[last], -1, after[last])
    whole[first[last]] = total[last] + size[last]
    return key[first], total, onward, whole


def _linked(chains: DataFrame, shift: int) -> DataFrame:
    """(scene_id, key, head, at, next, n) of ``chains`` (scene_id, key, next, n), linked within tiles of 2^shift cells."""
    row, col = F.shiftright("key", COL_BITS + 2), F.shiftright("key", 2).bitwiseAND((1 << COL_BITS) - 1)
    tiled = chains.select("scene_id", F.shiftright(row, shift).alias("tr"), F.shiftright(col, shift).alias("tc"), "key", "next", "n")
    group = ["scene_id", "tr", "tc"]
    dealt = tiled.repartition(*group).sortWithinPartitions(*group)

    def compute(t: pa.Table) -> pa.RecordBatch:
        scene = t.column("scene_id").combine_chunks()
        code = scene.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, after, size = (t.column(c).to_numpy() for c in ("key", "next", "n"))
        head, at, onward, whole = contracted(code, key, after, size)
        return pa.RecordBatch.from_arrays([scene, pa.array(key), pa.array(head), pa.array(at), pa.array(onward), pa.array(whole)], names=["scene_id", "key", "head", "at", "next", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < st.TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            last = int(st._starts(t, group)[-1])  # the last tile may go on
            if last:
                yield compute(t.slice(0, last))
                t = t.slice(last)
                held, size = t.to_batches(), len(t)
        if size:
            yield compute(pa.Table.from_batches(held))

    kind = chains.schema["scene_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"scene_id {kind}, key long, head long, at long, next long, n long")


def ringed(found: DataFrame, shift: int = 8) -> DataFrame:
    """``found`` edges with ``ring``, the smallest key of theirs, and ``seq``, the steps from there.

    shift: the first tiles are of 2^shift cells each way, and those of a round four times as wide as the last ones.
    """
    rounds, chains = [], found.select("scene_id", "key", "next", F.lit(1).cast("long").alias("n"))
    while True:
        step = hydrology._kept(_linked(chains, shift))
        rounds.append(step)
        chains = step.filter("key = head AND next >= 0").select("scene_id", "key", "next", "n")
        if not chains.limit(1).count():
            break
        if shift > COL_BITS:
            raise RuntimeError("the rings do not close")
        shift += 2
    placed = None
    for step in reversed(rounds):
        heads = step.filter("key = head").select("scene_id", "head", (F.col("next") < 0).alias("closed"), F.col("n").alias("_n"))
        own = step.select("scene_id", "key", "head", "at").join(heads, ["scene_id", "head"])
        if placed is None:
            placed = own.select("scene_id", "key", F.col("head").alias("loop"), F.col("at").alias("pos"), F.col("_n").alias("length"))
            continue
        up = placed.select("scene_id", F.col("key").alias("head"), "loop", "pos", "length")
        j = own.join(up, ["scene_id", "head"], "left")
        placed = j.select("scene_id", "key", F.coalesce("loop", "head").alias("loop"), (F.coalesce("pos", F.lit(0)) + F.col("at")).alias("pos"), F.coalesce("length", "_n").alias("length"))
    start = placed.groupBy("scene_id", "loop").agg(F.min("key").alias("ring"), F.min_by("pos", "key").alias("_zero"))
    placed = placed.join(start, ["scene_id", "loop"]).select("scene_id", "key", "ring", F.pmod(F.col("pos") - F.col("_zero"), F.col("length")).alias("seq"))
    return found.join(placed, ["scene_id", "key"])


def outlines(regions: DataFrame, shift: int = 8) -> DataFrame:
    """(scene_id, region, value, ring, seq, x, y, side, row, corner): every edge in its place along its ring; (x, y) is its end.

    Outer rings run clockwise with y downwards, holes the other way; the cell is to the right.
    """
    x = F.col("col") + F.when(F.col("side") <= 1, 1).otherwise(0)
    y = F.col("row") + F.when((F.col("side") == 1) | (F.col("side") == 2), 1).otherwise(0)
    return ringed(edges(regions), shift).select("scene_id", "region", "value", "ring", "seq", x.alias("x"), y.alias("y"), "side", "row", "corner")


def measures(outlined: DataFrame) -> DataFrame:
    """(scene_id, region, value, ring, area, perimeter, corners) in cells: areas of holes are negative."""
    part = F.when(F.col("side") == 0, -F.col("row")).when(F.col("side") == 2, F.col("row") + 1).otherwise(0).cast("long")
    return outlined.groupBy("scene_id", "region", "value", "ring").agg(F.sum(part).alias("area"), F.count("*").alias("perimeter"), F.count(F.when(F.col("corner"), 1)).alias("corners"))


def polygons(outlined: DataFrame, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), least_area: float | None = None) -> DataFrame:
    """(scene_id, region, value, area, geometry): a region's rings as GeoJSON text, the outer one first, then holes by their first edge.

    transform: (a, b, c, d, e, f) of map x = a col + b row + c and y = d col + e row + f. Regions below ``least_area`` in
    map units are left out. A polygon is one value, so a row is as long as the region's corners are many.
    """
    a, b, c, d, e, f = transform
    cell = abs(a * e - b * d)
    at = lambda k, l, m: F.lit(k) * F.col("x") + F.lit(l) * F.col("y") + F.lit(m)
    corner = F.struct("seq", F.array(at(a, b, c), at(d, e, f)).alias("p"))
    rings = outlined.filter("corner").groupBy("scene_id", "region", "value", "ring").agg(F.transform(F.array_sort(F.collect_list(corner)), lambda s: s["p"]).alias("p"))
    rings = rings.withColumn("p", F.concat("p", F.slice("p", 1, 1)))
    rings = rings.join(measures(outlined).select("scene_id", "ring", "area"), ["scene_id", "ring"])
    whole = rings.groupBy("scene_id", "region", "value").agg((F.sum("area") * cell).alias("area"), F.transform(F.array_sort(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), "ring", "p"))), lambda s: s["p"]).alias("coordinates"))
    if least_area is not None:
        whole = whole.filter(F.col("area") >= least_area)
    return whole.select("scene_id", "region", "value", "area", F.to_json(F.struct(F.lit("Polygon").alias("type"), "coordinates")).alias("geometry"))


def vectorized(pixels: DataFrame, threshold: float | None = None, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), least_area: float | None = None, shift: int = 8) -> DataFrame:
    """Polygons of the 4-connected cells of one whole value of a raster; with a threshold, of the cells that reach it, as value 1."""
    if threshold is not None:
        pixels = pixels.filter(F.col("v") >= threshold).withColumn("v", F.lit(1.0))
    return polygons(outlines(hydrology._kept(hydrology.regions(pixels)), shift), transform, least_area)
