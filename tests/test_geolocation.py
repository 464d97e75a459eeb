"""Ground points, zero Doppler and geometry phases against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolathe.functions.geometry import WAVELENGTH_M, WGS84_A, WGS84_B
from geolathe.operators import geolocation as g
from geolathe.plans import geolocation as made

ORBIT = "orbit long, time double, x double, y double, z double, vx double, vy double, vz double"


def circle(k: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    turn, node = t * made.RATE + k * 0.0005, k * 0.00002
    e1 = np.array([math.cos(node), math.sin(node), 0.0])
    e2 = np.array([-math.sin(node) * math.cos(made.TILT), math.cos(node) * math.cos(made.TILT), math.sin(made.TILT)])
    return made.RADIUS * (math.cos(turn) * e1 + math.sin(turn) * e2), made.RADIUS * made.RATE * (math.cos(turn) * e2 - math.sin(turn) * e1)


def vectors(spark, orbits=(0, 1), times=range(0, 120, 2)):
    return spark.createDataFrame([(k, float(t), *map(float, np.concatenate(circle(k, t)))) for k in orbits for t in times], ORBIT)


def residuals(p: np.ndarray, s: np.ndarray, v: np.ndarray, r: float, h: float) -> tuple[float, float, float]:
    return np.linalg.norm(p - s) - r, v @ (p - s) / np.linalg.norm(v), (p[0] ** 2 + p[1] ** 2) / (WGS84_A + h) ** 2 + p[2] ** 2 / (WGS84_B + h) ** 2 - 1


@pytest.mark.parametrize("side", [1, -1])
def test_ground_points_satisfy_their_equations(spark, side):
    rows = [(i, 0, 3.0 + 1.7 * i, 730_000.0 + 9_000 * i, -200.0 + 150.0 * i) for i in range(60)]
    px = spark.createDataFrame(rows, "id int, orbit long, time double, range_m double, height double")
    got = g.locate(px, vectors(spark), "orbit", "time", "range_m", F.col("height"), side).collect()
    assert len(got) == 60
    for r in got:
        s, v = circle(0, r["time"])
        p = np.array([r["px"], r["py"], r["pz"]])
        a, b, c = residuals(p, s, v, r["range_m"], r["height"])
        assert abs(a) < 1e-5 and abs(b) < 1e-3 and abs(c) < 1e-11
        assert np.sign(np.cross(v, s) @ (p - s)) == side
        assert abs(math.degrees(math.atan2(r["py"], r["px"])) - r["lon"]) < 1e-9


def test_points_that_do_not_exist_are_null(spark):
    rows = [(1, 0, 10.0, 500_000.0, 0.0), (2, 0, 10.0, 9_000_000.0, 0.0), (3, 0, 10.0, None, 0.0), (4, 0, None, 9e5, 0.0), (5, 0, 500.0, 9e5, 0.0), (6, 7, 10.0, 9e5, 0.0), (7, None, 10.0, 9e5, 0.0), (8, 0, 10.0, 9e5, None), (9, 0, 10.0, 9e5, 0.0)]
    px = spark.createDataFrame(rows, "id int, orbit long, time double, range_m double, height double")
    got = {r["id"]: r["px"] for r in g.locate(px, vectors(spark), "orbit", "time", "range_m", F.col("height")).collect()}
    assert [i for i, x in got.items() if x is not None] == [9] and len(got) == 9
    few = vectors(spark, (0,), range(0, 8, 2))
    assert g.locate(px, few, "orbit", "time", "range_m", F.col("height")).filter("px IS NOT NULL").count() == 0
    assert g.locate(px.limit(0), few, "orbit", "time", "range_m", F.col("height")).count() == 0


def test_states_at_vectors_and_ends(spark):
    v = vectors(spark).union(vectors(spark, (1,), (4, 6)))  # repeated vectors
    t = spark.createDataFrame([(k, x) for k in (0, 1) for x in (0.0, 0.3, 1.0, 57.3, 118.0, 118.1, -0.1)], "orbit long, at double")
    got = g.states(t, v, "orbit", "time", "at").collect()
    assert len(got) == 14
    for r in got:
        if 0 <= r["at"] <= 118:
            assert np.allclose([r[n] for n in "xyz"], circle(r["orbit"], r["at"])[0], atol=1e-4)
        else:
            assert r["x"] is None


def test_zero_doppler_there_and_back(spark):
    rows = [(i, 0, 20.0 + i, 800_000.0 + 7_000 * i, 40.0 * i) for i in range(40)]
    px = spark.createDataFrame(rows, "id int, orbit long, time double, range_m double, height double")
    at = g.locate(px, vectors(spark), "orbit", "time", "range_m", F.col("height"))
    for shift in (0.0, 13.0, -13.0):
        got = g.zero_doppler(at.withColumn("guess", F.col("time") + shift), vectors(spark), "orbit", "time", "guess").collect()
        assert len(got) == 40 and all(abs(r["zero_time"] - r["time"]) < 1e-7 and abs(r["zero_time_range"] - r["range_m"]) < 1e-4 for r in got)
    far = g.zero_doppler(at.withColumn("guess", F.col("time") + 1_000.0), vectors(spark), "orbit", "time", "guess")
    assert far.filter("zero_time IS NOT NULL").count() == 0 and far.count() == 40


def _point(k: int, t: float, r: float, h: float) -> np.ndarray:
    s, v = circle(k, t)
    d, c = -s / np.linalg.norm(s), np.cross(v, s) / np.linalg.norm(np.cross(v, s))
    lo, hi = 0.0, 1.2
    for _ in range(60):
        m = (lo + hi) / 2
        p = s + r * (math.cos(m) * d + math.sin(m) * c)
        lo, hi = (lo, m) if (p[0] ** 2 + p[1] ** 2) / (WGS84_A + h) ** 2 + p[2] ** 2 / (WGS84_B + h) ** 2 > 1 else (m, hi)
    return p


def _phase(t: float, r: float, h: float) -> float:
    """Of orbits 0 and 1, whose circle passes closest where the point lies in its plane's direction."""
    p = _point(0, t, r, h)
    e1, e2 = circle(1, -0.0005 / made.RATE)[0], circle(1, (math.pi / 2 - 0.0005) / made.RATE)[0]
    turn = math.atan2(p @ e2, p @ e1)
    return 4 * math.pi / WAVELENGTH_M * (np.linalg.norm(p - (math.cos(turn) * e1 + math.sin(turn) * e2)) - r)


def test_geometry_at_nodes_and_between(spark):
    frames = spark.createDataFrame([("p", 0, 1, 400, 600, 30.0, 0.004, 845_000.0, 30.0, -0.4)], "pair string, reference long, secondary long, rows int, cols int, first_time double, row_s double, near_range double, col_m double, shift double")
    nodes = g.geometry_nodes(frames, vectors(spark), "pair")
    got = nodes.collect()
    assert len(got) == 81
    for r in got[::7]:
        t, far = 30 + r["row"] * 0.004, 845_000 + r["col"] * 30
        assert abs(r["phase_flat"] - _phase(t, far, 0)) < 1e-4
        assert abs(r["phase_flat"] + 300 * r["k1"] + 300**2 / 2 * r["k2"] - _phase(t, far, 300)) < 1e-3
        s, _ = circle(0, t)
        assert 20 < r["incidence"] < 60 and r["range_m"] == far and s[0] > 0
    rows = [("p", a, b, h) for a, b, h in ((0, 0, 0.0), (399, 599, 100.0), (17, 333, 900.0), (200, 1, 0.0), (398, 300, -50.0))]
    px = spark.createDataFrame(rows + [("q", 1, 1, 0.0), ("p", None, 1, 0.0)], "pair string, row int, col int, h double")
    dense = g.at_pixels(px, nodes, frames, "pair").withColumn("phase", g.geometric_phase(F.col("h")))
    found = {(r["row"], r["col"]): r["phase"] for r in dense.filter("pair = 'p'").collect()}
    for _, a, b, h in rows:
        assert abs(found[a, b] - _phase(30 + a * 0.004, 845_000 + b * 30, h)) < 2e-3
    assert dense.filter("phase IS NULL").count() == 2 and found[None, 1] is None
    left = g.without_geometry(dense, F.col("phase") + 0.25, F.col("h")).filter("residual IS NOT NULL").collect()
    assert len(left) == 5 and all(abs(r["residual"] - 0.25) < 1e-9 for r in left)
