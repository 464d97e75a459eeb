"""Resampling across tiles, fields of offsets and terrain heights against known surfaces."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolathe.operators import coregister as cr
from geolathe.operators import geolocation as g
from test_geolocation import vectors

RASTER, REQUEST = "scene_id long, row int, col int, v double", "scene_id long, row int, col int, at_row double, at_col double"


def smooth(r, c):
    return np.sin(r / 7) + np.cos(c / 9) * 2 + 0.01 * r * c / 10


def raster(spark, rows: int = 60, cols: int = 50, skip=(), f=smooth):
    return spark.createDataFrame([(1, r, c, float(f(r, c))) for r in range(rows) for c in range(cols) if (r, c) not in skip], RASTER)


@pytest.mark.parametrize("tile", [8, 16, 256])
def test_a_known_warp_comes_back(spark, tile):
    warp = lambda r, c: (0.3 + 0.02 * r - 0.01 * c, -0.6 + 0.015 * c)
    got = cr.moved(raster(spark), 0.3 + 0.02 * F.col("row") - 0.01 * F.col("col"), -0.6 + 0.015 * F.col("col"), tile=tile).collect()
    assert len(got) == 3000
    seen = 0
    for r in got:
        dr, dc = warp(r["row"], r["col"])
        y, x = r["row"] + dr, r["col"] + dc
        inside = 1 <= y < 58 and 1 <= x < 48
        if inside:
            assert abs(r["v"] - smooth(y, x)) < 2e-3
            seen += 1
        elif not (0 <= y <= 59 and 0 <= x <= 49):
            assert r["v"] is None
    assert seen > 2000


@pytest.mark.parametrize("kernel,degree", [("cubic", 2), ("linear", 1), ("nearest", 0)])
def test_kernels_give_back_their_surfaces(spark, kernel, degree):
    f = {2: lambda r, c: 1 + r - 2 * c + 0.5 * r * r - r * c + 0.25 * c * c, 1: lambda r, c: 3 - r + 2 * c, 0: lambda r, c: 4.0 + 0 * r}[degree]
    rng = random.Random(1)
    rows = [(1, i, 0, rng.uniform(2, 56), rng.uniform(2, 46)) for i in range(200)] + [(1, 200 + i, 1, float(i), float(i)) for i in range(50)]
    got = {r["row"]: r["v"] for r in cr.resampled(raster(spark, f=f), spark.createDataFrame(rows, REQUEST), kernel=kernel, tile=16, together=30).collect()}
    assert len(got) == 250 and all(got[i] == pytest.approx(f(y, x), abs=1e-9) for _, i, _, y, x in rows)


def test_places_without_a_value(spark):
    rows = [(1, 0, 0, 10.5, 10.5), (1, 1, 0, 20.0, 20.0), (1, 2, 0, None, 1.0), (1, 3, 0, float("nan"), 1.0), (1, 4, 0, 1e300, 1.0), (1, 5, 0, -0.5, 3.0), (2, 6, 0, 5.0, 5.0), (1, 7, 0, 21.0, 20.0), (1, 8, 0, 59.0, 49.0), (1, 1, 0, 20.0, 20.0)]
    got = cr.resampled(raster(spark, skip={(11, 11), (21, 20)}), spark.createDataFrame(rows, REQUEST))
    found = {(r["scene_id"], r["row"]): r["v"] for r in got.collect()}
    assert got.count() == len(rows)
    assert {k for k, v in found.items() if v is not None} == {(1, 1), (1, 8)} and found[1, 1] == pytest.approx(smooth(20, 20))
    assert cr.resampled(raster(spark).limit(0), spark.createDataFrame(rows, REQUEST)).filter("v IS NOT NULL").count() == 0
    assert cr.resampled(raster(spark), spark.createDataFrame([], REQUEST)).count() == 0


def controls(n: int, measured: int, bias=(0.5, -0.25), wild: int = 0, seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    at = lambda: (rng.uniform(0, 4000), rng.uniform(0, 9000))
    rows = [(1, False, r, c, 1 + 0.001 * r - 0.0002 * c, -2 + 0.0005 * c) for r, c in (at() for _ in range(n))]
    for k in range(measured):
        r, c = at()
        off = 20.0 if k < wild else 0.0
        rows.append((1, True, r, c, 1 + 0.001 * r - 0.0002 * c + bias[0] + 0.0001 * r * (len(bias) > 2) + rng.gauss(0, 0.01) + off, -2 + 0.0005 * c + bias[1] + rng.gauss(0, 0.01)))
    return rows


CONTROL = "scene_id long, measured boolean, row double, col double, d_row double, d_col double"


@pytest.mark.parametrize("measured,wild,mode,used", [(0, 0, "geometry", 0), (1, 0, "geometry", 1), (5, 0, "geometry and constant", 5), (20, 3, "geometry and plane", 17), (9, 2, "geometry and constant", 7)])
def test_fields_correct_only_what_is_supported(spark, measured, wild, mode, used):
    f = cr.geometry_first(spark.createDataFrame(controls(30, measured, wild=wild), CONTROL)).first()
    assert f["mode"] == mode and f["n_used"] == used and f["n_measured"] == measured and f["n_geometry"] == 30
    bias = (0.5, -0.25) if mode != "geometry" else (0.0, 0.0)
    for r, c in ((0, 0), (4000, 9000), (2000, 100)):
        at = [sum(t * m for t, m in zip(f[k], (1, r, c))) for k in ("row_terms", "col_terms")]
        assert at == pytest.approx([1 + 0.001 * r - 0.0002 * c + bias[0], -2 + 0.0005 * c + bias[1]], abs=0.04)
    assert measured < 2 or f["rms"] < 0.05


def test_fields_of_few_or_no_points(spark):
    fit = lambda rows, **how: cr.geometry_first(spark.createDataFrame(rows, CONTROL), **how)
    assert fit(controls(2, 9)).count() == 0 and fit([]).count() == 0
    two = fit(controls(5, 0) + [(1, True, None, 1.0, 1.0, 1.0)], degree=2)
    assert len(two.first()["row_terms"]) == 3 and two.first()["n_measured"] == 0
    at = two.selectExpr("*", "10.0 AS row", "20.0 AS col").select(cr.offset_at("row_terms", F.col("row"), F.col("col"), 2)).first()[0]
    assert at == pytest.approx(1 + 0.01 - 0.004)


def test_heights_of_the_terrain(spark):
    """Pixels at their own range and time: the height must be that of the dem where the pixel lies."""
    frame = [(1, i, j) for i in range(0, 40, 8) for j in range(0, 60, 12)]
    px = spark.createDataFrame(frame, "scene_id long, row int, col int")
    located = lambda p, h: g.locate(p.withColumns({"orbit": F.lit(0).cast("long"), "time": 40 + F.col("row") * 0.02, "range_m": 850_000.0 + F.col("col") * 100.0}), vectors(spark), "orbit", "time", "range_m", h)
    flat = located(px.withColumn("height", F.lit(0.0)), F.col("height")).toPandas()
    lat0, lon0, step = flat["lat"].max() + 0.3, flat["lon"].min() - 0.3, 0.01
    rows, cols = (int((flat[n].max() - flat[n].min() + 0.6) / step) + 2 for n in ("lat", "lon"))
    dem = raster(spark, rows, cols, f=lambda r, c: 300 + 2.0 * r - 1.0 * c)
    got = cr.terrain_heights(px, dem, float(lat0), float(lon0), step, located, rounds=4)
    at = located(got, F.col("height")).select("row", "col", "height", "lat", "lon").collect()
    assert len(at) == 25
    for r in at:
        assert abs(r["height"] - (300 + 2.0 * (lat0 - r["lat"]) / step - 1.0 * (r["lon"] - lon0) / step)) < 0.5
        assert not math.isnan(r["height"])
