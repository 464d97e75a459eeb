"""Networks by pixel: dealt once, over partitions that grow with the table, and closures without joins."""

from __future__ import annotations

import random

import pytest

from __spark_entry__ import queries
from geolathe.operators import inversion
from geolathe.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sbas_wls", "sbas_usable_pixels", "sbas_bridge_penalty", "sbas_with_heights", "phase_closures"])
def test_one_exchange_whatever_its_partitions(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "ROWS", 400)
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pixel") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert df.rdd.getNumPartitions() >= 14  # of 6,000 rows


def test_closures_with_copies_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice((1, 2, 3, None)), rng.choice((0, 1, 2, 3, None)), rng.choice((1, 2, 3, 4)), rng.choice((None, rng.uniform(-9, 9)))) for _ in range(120)]
    got = inversion.closures(spark.createDataFrame(rows, "pixel long, d1 int, d2 int, phase double")).select("pixel", "a", "b", "c", "closure").collect()
    want = [
        (p, a, b, c, None if None in (u, v, w) else u + v - w)
        for p, a, b, u in rows if p is not None and a is not None
        for q, b2, c, v in rows if q == p and b2 == b
        for r, a2, c2, w in rows if r == p and a2 == a and c2 == c
    ]
    assert len(want) > 200 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
