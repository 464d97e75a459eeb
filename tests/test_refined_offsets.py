"""Offsets mended by coherence: planted fractional shifts come back."""

from __future__ import annotations

import numpy as np
import pytest

from geolathe.operators import coregister as cr

IMAGE = "scene_id long, row int, col int, re double, im double"
POINTS = "scene_id long, point long, row double, col double, d_row double, d_col double"


def waves(seed: int):
    rng = np.random.default_rng(seed)
    k, a = rng.uniform(-0.9, 0.9, (60, 2)), rng.normal(size=60) + 1j * rng.normal(size=60)
    return lambda r, c: (a * np.exp(1j * (k[:, 0] * r + k[:, 1] * c))).sum()


def image(spark, g, dr=0.0, dc=0.0, size=90, hole=None):
    rows = []
    for r in range(size):
        for c in range(size):
            if (r, c) != hole:
                z = g(r - dr, c - dc)
                rows.append((1, r, c, float(z.real), float(z.imag)))
    return spark.createDataFrame(rows, IMAGE)


@pytest.mark.parametrize("tile", [16, 256])
def test_planted_shift_comes_back_from_a_bad_guess(spark, tile):
    g = waves(1)
    points = [(1, 0, 40.0, 45.0, 5.0, -1.0), (1, 1, 45.5, 41.25, 2.0, -4.0), (1, 2, 5.0, 40.0, 3.0, -2.0), (1, 3, 44.0, 44.0, None, 1.0)]
    got = {p.point: p for p in cr.refined_by_coherence(spark.createDataFrame(points, POINTS), image(spark, g), image(spark, g, 3.4, -2.3), window=16, tile=tile).collect()}
    assert sorted(got) == [0, 1]  # too near the edge, no guess
    for p in got.values():
        assert p.d_row == pytest.approx(3.4, abs=0.06) and p.d_col == pytest.approx(-2.3, abs=0.06) and p.coherence > 0.98


def test_unlike_images_and_holes_give_no_points(spark):
    points = spark.createDataFrame([(1, 0, 45.0, 45.0, 0.0, 0.0)], POINTS)
    g = waves(1)
    assert cr.refined_by_coherence(points, image(spark, g), image(spark, waves(2)), window=32, least=0.8).count() == 0
    assert cr.refined_by_coherence(points, image(spark, g), image(spark, g, hole=(45, 50)), window=16).count() == 0
