"""Outlines of regions against counts of cells and rings that are filled again."""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pytest

from geolathe.operators import hydrology, outlines

SCHEMA = "scene_id long, row int, col int, v double"


def raster(seed: int, h: int, w: int, values: int = 2) -> dict[tuple[int, int], int]:
    rng = np.random.default_rng(seed)
    return {(i, j): int(rng.integers(values)) for i in range(h) for j in range(w) if rng.random() > 0.02}


def labelled(cells: dict) -> dict:
    """Cells by the first cell of their region."""
    out: dict = {}
    for start in sorted(cells):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            r, c = todo.pop()
            for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if n in cells and n not in out and cells[n] == cells[start]:
                    out[n] = start
                    todo.append(n)
    return out


def filled(rings: list, h: int, w: int) -> set:
    """Cells whose centre has an odd number of vertical ring edges to its left."""
    odd = np.zeros((h, w), int)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if x0 == x1:
                odd[int(min(y0, y1)) : int(max(y0, y1)), int(x0) :] ^= 1
    return set(map(tuple, np.argwhere(odd).tolist()))


@pytest.mark.parametrize("seed,h,w,shift", [(1, 30, 41, 2), (2, 30, 41, 8), (3, 1, 17, 1), (4, 50, 50, 1)])
def test_rings_give_their_regions_back(spark, seed, h, w, shift):
    cells = raster(seed, h, w)
    rows = [(7, r, c, float(v)) for (r, c), v in cells.items()]
    got = outlines.vectorized(spark.createDataFrame(rows, SCHEMA), shift=shift).collect()
    want = defaultdict(set)
    for cell, first in labelled(cells).items():
        want[first].add(cell)
    assert len(got) == len(want)
    for p in got:
        first = (p.region >> 26, p.region & ((1 << 26) - 1))
        rings = json.loads(p.geometry)["coordinates"]
        assert filled(rings, h, w) == want[first] and p.area == len(want[first]) and p.value == cells[first]
        assert all(r[0] == r[-1] and len(r) >= 5 for r in rings)
        assert all((a[0] == b[0]) != (b[0] == c[0]) for r in rings for a, b, c in zip(r, r[1:], [*r[2:], r[1]]))  # bends at every corner


def test_a_ring_through_many_tiles_keeps_its_order(spark):
    """A spiral one cell wide: one ring as long as twice the way."""
    n, cells, r, c, d = 41, {}, 0, 0, 0
    steps = ((0, 1), (1, 0), (0, -1), (-1, 0))
    cells[0, 0] = 1
    while True:
        for _ in range(2):
            i, j = r + steps[d][0], c + steps[d][1]
            k, m = i + steps[d][0], j + steps[d][1]
            if 0 <= i < n and 0 <= j < n and (i, j) not in cells and (k, m) not in cells:
                break
            d = (d + 1) % 4
        else:
            break
        r, c = i, j
        cells[r, c] = 1
    rows = [(1, i, j, 1.0) for i, j in cells]
    o = outlines.outlines(hydrology.regions(spark.createDataFrame(rows, SCHEMA)), shift=2)
    e = o.orderBy("seq").collect()
    assert [x.seq for x in e] == list(range(2 * len(cells) + 2))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(e, e[1:] + e[:1]))
    m = outlines.measures(o).collect()
    assert [(x.area, x.perimeter) for x in m] == [(len(cells), 2 * len(cells) + 2)]


def test_threshold_transform_and_least_area(spark):
    v = [[0.1, 0.9, 0.8], [0.2, 0.7, 0.1], [0.9, 0.1, 0.1]]
    rows = [(1, i, j, v[i][j]) for i in range(3) for j in range(3)] + [(2, 0, 0, None)]
    got = outlines.vectorized(spark.createDataFrame(rows, SCHEMA), 0.5, (10.0, 0.0, 500.0, 0.0, -10.0, 900.0), 150.0).collect()
    assert [(p.scene_id, p.value, p.area) for p in got] == [(1, 1, 300.0)]
    ring = json.loads(got[0].geometry)["coordinates"][0]
    assert {tuple(p) for p in ring} == {(510.0, 900.0), (530.0, 900.0), (530.0, 890.0), (520.0, 890.0), (520.0, 880.0), (510.0, 880.0)}


def test_no_cells_have_no_rings(spark):
    assert outlines.vectorized(spark.createDataFrame([], SCHEMA)).collect() == []
