"""Orbits far larger than the given ones: no orbit in one task, no piece broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geolathe.operators import geolocation as g


def _vectors(spark, n):
    at = F.col("id").cast("double")
    return spark.range(n).select(F.lit(1).alias("orbit"), (at * 3.0 + F.sin(at)).alias("time"), *[(F.sin(at * 0.01 + k) * 1000).alias(c) for k, c in enumerate(g.STATE)])


def test_pieces_do_not_depend_on_lots(spark, monkeypatch):
    lots = g._lots
    rows = lambda: [r.asDict(True) for r in g.orbit_pieces(_vectors(spark, 300), "orbit", "time").orderBy("t").collect()]
    want = rows()
    monkeypatch.setattr(g, "_lots", lambda v, key, halo: lots(v, key, halo, 50.0, 7))
    got = rows()
    assert got == want and len(got) == 300 and [r["last"] for r in got] == [False] * 299 + [True]
    assert all(a["s1"] == b["s0"] and a["t1"] == b["t0"] for a, b in zip(got, got[1:]))


def test_states_across_lots(spark):
    targets = spark.range(1200).select(F.lit(1).alias("orbit"), (F.col("id") * 3.0 + 1.0).alias("time"))
    vectors = spark.range(1300).select(F.lit(1).alias("orbit"), (F.col("id") * 3.0).alias("time"), *[(F.sin(F.col("id") * 0.03 + k) * 1000).alias(c) for k, c in enumerate(g.STATE)])
    got = g.states(targets, vectors, "orbit", "time").toPandas()
    assert np.abs(got["x"] - np.sin(got["time"] * 0.01) * 1000).max() < 1e-4


def test_no_piece_is_broadcast_and_no_orbit_in_one_window(spark):
    v = _vectors(spark, 100)
    points = spark.range(5).select(F.lit(1).alias("orbit"), (F.col("id") * 10.0).alias("guess"), *[F.lit(1.0).alias(n) for n in ("px", "py", "pz")])
    for df in (g.states(points, v, "orbit", "time", "guess"), g.zero_doppler(points, v, "orbit", "time", "guess")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert "collect_list" in plan and "_lot" in plan


def test_only_the_nodes_that_pixels_need(spark):
    frames = spark.createDataFrame([(7, 1, 1, 80, 80, 30.0, 0.1, 840_000.0, 13.0, 0.0)], "pair long, reference int, secondary int, rows int, cols int, first_time double, row_s double, near_range double, col_m double, shift double")
    pixels = spark.createDataFrame([(7, 40, 79), (7, 41, 79)], "pair long, row int, col int")
    nodes = g.geometry_nodes(frames, _vectors(spark, 30), "pair", pixels=pixels).select("i", "j").collect()
    assert sorted(map(tuple, nodes)) == [(i, j) for i in range(3, 7) for j in range(5, 9)]
