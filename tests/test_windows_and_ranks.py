"""The spectral filter against its formula, pan-sharpening's cases, ranks in place of buffers."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolathe.functions import radiometry
from geolathe.operators import fits, phase, series


def plain_goldstein(z: np.ndarray, alpha: float, size: int) -> np.ndarray:
    h, w = z.shape
    out, weight = np.zeros_like(z), np.zeros(z.shape)
    taper = np.outer(np.hanning(size), np.hanning(size))
    places = lambda n: sorted({*range(0, max(1, n - size + 1), size // 2), max(0, n - size)})
    for i in places(h):
        for j in places(w):
            part = z[i : i + size, j : j + size]
            f = np.fft.fft2(part)
            g = np.fft.ifft2(f * (np.abs(f) / np.abs(f).max()) ** alpha)
            t = taper[: part.shape[0], : part.shape[1]]
            out[i : i + size, j : j + size] += g * t
            weight[i : i + size, j : j + size] += t
    return np.where(weight > 0, out / np.where(weight > 0, weight, 1), z)


@pytest.mark.parametrize("shape,size,tile", [((70, 90), 8, 16), ((70, 90), 8, 256), ((50, 37), 16, 16), ((9, 30), 16, 16), ((33, 41), 6, 20)])
def test_goldstein_is_its_formula_whatever_the_tiles(spark, shape, size, tile):
    rng = np.random.default_rng(size)
    y, x = np.indices(shape)
    a = np.angle(np.exp(1j * (0.3 * x + 0.1 * y + rng.standard_normal(shape) * (x < shape[1] // 2))))
    rows = [(1, int(r), int(c), float(a[r, c])) for r, c in np.ndindex(shape)]
    got = phase.goldstein(spark.createDataFrame(rows, "scene_id long, row int, col int, v double"), 0.5, size, tile).collect()
    want = np.angle(plain_goldstein(np.exp(1j * a), 0.5, size))
    assert len(got) == a.size
    assert max(abs(np.angle(np.exp(1j * (r["out"] - want[r["row"], r["col"]])))) for r in got) < 1e-9


def test_sharpening_of_dark_pixels(spark):
    t = spark.createDataFrame([(10.0, 1.0, 2.0, 3.0), (10.0, 0.0, 0.0, 0.0), (10.0, -1.0, -2.0, 1.0), (None, 1.0, 1.0, 1.0), (10.0, None, 1.0, 1.0)], "p double, a double, b double, c double")
    got = {m: [tuple(r) for r in t.select(*radiometry.pansharpened(F.col("p"), [F.col(c) for c in "abc"], m)).collect()] for m in ("brovey", "ihs", "gram_schmidt", "mean")}
    assert got["brovey"][0] == pytest.approx((10 / 6, 20 / 6, 5)) and got["brovey"][1] == (0, 0, 0) and got["ihs"][0] == pytest.approx((5, 10, 15))
    assert got["ihs"][1] == (0, 0, 0) and got["mean"][2] == (-1, -2, 1) and got["mean"] == got["gram_schmidt"] and got["brovey"][3] == (None,) * 3 and got["mean"][4] == (None,) * 3
    assert [tuple(r) for r in t.limit(1).select(*radiometry.pansharpened(F.col("p"), [F.col("a"), F.col("b")], "ihs")).collect()] == [pytest.approx((10, 20))]


def test_percentiles_by_ranks(spark):
    rng = random.Random(2)
    rows = [(i, d, rng.choice([1.0, 1.0, rng.uniform(0, 3)])) for i in range(60) for d in range(4)]
    got = series.scatterers(spark.createDataFrame(rows, "row int, col int, v double").withColumn("d", F.lit(1)), by=["row"], threshold=9, share=0.7).collect()
    at = np.percentile([r["amplitude"] for r in got], 70)
    assert len(got) == 60 and all(r["ps"] == (r["amplitude"] > at) for r in got)
    picks = [(n, k, rng.random() < 0.6, rng.gauss(0, 1)) for n in ("a", "b") for k in range(80)] + [("none", 1, False, 0.5)]
    found = {r["name"]: r for r in series.compared_selections(spark.createDataFrame(picks, "name string, key int, picked boolean, quality double"), "a").collect()}
    for n in ("a", "b"):
        assert found[n]["median"] == pytest.approx(statistics.median(q for m, _, p, q in picks if m == n and p))
    assert found["none"]["median"] is None and found["none"]["n"] == 0 and found["a"]["added"] == 0
    make = lambda k: spark.createDataFrame([(i, float(rng.gauss(0, 2))) for i in range(100) if i % k], "row int, v double")
    a, b = make(5).cache(), make(7).cache()
    r = series.compared_maps(a, b, ["row"]).first()
    x, y = ({q["row"]: q["v"] for q in t.collect()} for t in (a, b))
    off = [y[k] - x[k] for k in x.keys() & y.keys()]
    assert r["median_off"] == pytest.approx(statistics.median(off)) and r["p95_off"] == pytest.approx(np.percentile(np.abs(off), 95)) and r["common"] == len(off)
    assert series.compared_maps(a.limit(0), b.limit(0), ["row"]).first()["median_off"] is None


def test_surface_without_what_is_far_off(spark):
    rng = random.Random(3)
    rows = [(x := rng.uniform(-1, 1), y := rng.uniform(-1, 1), 1 + 2 * x - 3 * y + (50.0 if i % 9 == 0 else rng.gauss(0, 0.01))) for i in range(200)]
    c, used = fits.robust_polynomial(spark.createDataFrame(rows, "x double, y double, o double"), "o", 1)
    assert c[0, 0] == pytest.approx(1, abs=0.01) and c[1, 0] == pytest.approx(2, abs=0.01) and c[0, 1] == pytest.approx(-3, abs=0.01)
    assert used.filter("used").count() == 200 - math.ceil(200 / 9)
