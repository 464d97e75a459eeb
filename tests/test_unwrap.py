"""Bridges between regions and closing cycles against plain versions and planted jumps."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from geolathe.operators import unwrap

TURN = 2 * math.pi
RASTER = "scene_id long, row int, col int, phase double, region int"


def blobs(seed: int, size: int = 90, n: int = 6) -> dict[tuple[int, int], int]:
    """Boxes of pixels that do not touch."""
    rng = random.Random(seed)
    out: dict = {}
    for label in range(1, n + 1):
        for _ in range(200):
            r, c, h, w = rng.randrange(size), rng.randrange(size), rng.randint(3, 14), rng.randint(3, 14)
            box = [(i, j) for i in range(r, r + h) for j in range(c, c + w)]
            if not any((i + a, j + b) in out for i, j in box for a in (-1, 0, 1) for b in (-1, 0, 1)):
                out |= dict.fromkeys(box, label)
                break
    return out


def rows_of(seed: int, jumps: dict[int, int], scene: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    return [(scene, i, j, 0.02 * i + 0.03 * j + rng.uniform(-0.3, 0.3) + jumps.get(label, 0) * TURN, label) for (i, j), label in blobs(seed).items()]


@pytest.mark.parametrize("seed,reach", [(1, 200), (2, 200), (3, 12)])
def test_gaps_are_the_nearest_pixels(spark, seed, reach):
    rows = [(1, i + 200, j - 37, 0.0, r) for (i, j), r in blobs(seed).items()]
    border = unwrap.border_pixels(spark.createDataFrame(rows, RASTER))
    assert 0 < border.count() < len(rows)
    got = {(r["a"], r["b"]): (r["far"], r["row_a"], r["col_a"], r["row_b"], r["col_b"]) for r in unwrap.gaps(border, reach).collect()}
    place = {}
    for _, i, j, _, r in rows:
        place.setdefault(r, []).append((i, j))
    want = {}
    for a, b in itertools.combinations(sorted(place), 2):
        d = min((math.dist(x, y), *x, *y) for x in place[a] for y in place[b])
        if d[0] <= reach:
            want[a, b] = d
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_forest_against_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        e = pd.DataFrame([(a, b, float(rng.randint(1, 9))) for a, b in itertools.combinations(range(5), 2) if rng.random() < 0.7], columns=["a", "b", "far"])
        got = unwrap.spanning_forest(e)

        def parts(rows) -> int:
            seen = {x: x for x in range(5)}
            for a, b in rows:
                seen = {k: seen[a] if v == seen[b] else v for k, v in seen.items()}
            return len(set(seen.values()))

        least = min(sum(f for *_, f in s) for k in range(len(e) + 1) for s in itertools.combinations(e.itertuples(index=False, name=None), k) if parts([x[:2] for x in s]) == parts(e[["a", "b"]].itertuples(index=False, name=None)))
        assert got["far"].sum() == least and len(got) == 5 - parts(e[["a", "b"]].itertuples(index=False, name=None))


def test_planted_jumps_of_regions_are_removed(spark):
    jumps = {s: {k: random.Random(s + k).randint(-3, 3) for k in range(1, 7)} for s in (5, 6)}
    rows = [r for s in (5, 6) for r in rows_of(s, jumps[s], s)]
    rows += [(5, 500, 500, 1.0, 0), (5, 501, 500, 2.0, None), (5, 600, 600, 3.0, 77), (9, 0, 0, 1.0, 4)]  # no region, and one too small
    table = spark.createDataFrame(rows, RASTER)
    got = unwrap.bridged(table, radius=6, least_size=9).collect()
    assert len(got) == len(rows)
    for s in (5, 6):
        sizes = {}
        for r in rows:
            if r[0] == s and r[4]:
                sizes[r[4]] = sizes.get(r[4], 0) + 1
        root = min(sizes, key=lambda k: (-sizes[k], k))
        for r in got:
            if r["scene_id"] == s and r["region"] in jumps[s]:
                assert r["bridged"] == pytest.approx(r["phase"] + (jumps[s][root] - jumps[s][r["region"]]) * TURN)
    assert {(r["row"], r["bridged"]) for r in got if r["row"] >= 500} == {(500, 1.0), (501, 2.0), (600, 3.0)}
    at = spark.createDataFrame([(5, *next((i, j) for (i, j), r in blobs(5).items() if r == 3))], "scene_id long, row int, col int")
    own = {r["region"]: r["cycles"] for r in unwrap.bridge_cycles(table, 6, 9, at).filter("scene_id = 5").collect()}
    assert own == {k: jumps[5][3] - v for k, v in jumps[5].items() if k in own} and own[3] == 0 and len(own) > 3
    assert unwrap.bridged(table.limit(0)).count() == 0


def network(n: int, reach: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(n) for b in range(a + 1, min(n, a + reach + 1))]


def off(pairs: list[tuple[int, int]], u: np.ndarray) -> np.ndarray:
    t, signs = unwrap.triangles(*np.array(pairs).T)
    return (u[t] * signs).sum(1)


def test_cycles_against_brute_force():
    """The least changes that close all triangles of four dates: found but in a few of the graphs with several jumps."""
    rng = random.Random(6)
    pairs = network(4, 3)
    every = [np.array(u) for u in itertools.product((-1, 0, 1), repeat=len(pairs))]
    cost = []
    for k in range(120):
        planted = np.array([rng.choice((-1, 0, 0, 0, 1)) if k % 2 else int(e == k % 6) for e in range(len(pairs))])
        level = np.cumsum([rng.uniform(-2, 2) for _ in range(4)])
        phase = np.array([level[b] - level[a] for a, b in pairs]) + TURN * planted
        got = unwrap.whole_cycles(*np.array(pairs).T, phase, np.array([rng.random() for _ in pairs]))
        least = min(np.abs(u).sum() for u in every if not off(pairs, planted + u).any())
        if not off(pairs, planted + got).any():
            cost.append(np.abs(got).sum() - least)
        if k % 2 == 0:
            assert (got == -planted).all()
    assert len(cost) >= 114 and np.mean(np.array(cost) == 0) >= 0.95


def test_planted_jumps_of_pairs_are_removed(spark):
    rng = random.Random(7)
    rows, planted = [], {}
    for pixel in range(40):
        level = [rng.uniform(-9, 9) for _ in range(9)]
        at = rng.sample([p for p in network(9, 3) if 1 < p[0] and p[1] < 7], 1)
        for a, b in network(9, 3):
            jump = rng.choice((-2, -1, 1, 2)) if (a, b) in at else 0
            if jump:
                planted[pixel, a, b] = -jump
            rows.append((pixel, a, b, level[b] - level[a] + jump * TURN + rng.uniform(-0.1, 0.1), rng.random()))
    extra = [(100, 0, 1, 9.0, 0.1), (101, 0, 1, None, 0.2), (None, 0, 1, 1.0, 0.3), (102, None, 1, 1.0, 0.3), (103, 0, 1, 50.0, None), (103, 1, 2, 0.0, 0.9), (103, 0, 2, 50.0 - 8 * TURN, 0.9), (0, *rows[0][1:])]
    table = spark.createDataFrame(rows + extra, "pixel long, d1 int, d2 int, phase double, coherence double")
    got = {(r["pixel"], r["d1"], r["d2"]): r["cycles"] for r in unwrap.closing_cycles(table).collect()}
    assert got.pop((103, 0, 1)) == -8 and got == planted
    assert unwrap.closed(table).count() == len(rows) + len(extra) and unwrap.closed(table.limit(0)).count() == 0
