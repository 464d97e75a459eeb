"""Drawn risks: repeatable, and like the formula where there is one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolathe.operators import resampling

SERIES = "row int, col int, t int, v double"


def rows(n: int = 30, dates: int = 40) -> list[tuple]:
    rng = np.random.default_rng(1)
    return [(p, 0, k, float(0.05 * p * k / dates + rng.normal(0, 0.2))) for p in range(n) for k in range(dates)]


@pytest.mark.parametrize("how", ["bootstrap", "monte_carlo"])
def test_draws_do_not_depend_on_partitions(spark, how):
    data = rows()
    run = lambda d, **k: sorted(map(tuple, resampling.drawn_risk(d, ["row", "col"], F.col("t"), how, 200, **k).collect()))
    table = spark.createDataFrame(data, SERIES)
    a, b = run(table.repartition(1)), run(table.orderBy(F.desc("t")).repartition(7, "t"))
    assert a == b and len(a) == 30 and run(table, seed=5) != a
    assert run(table.filter("row = 3")) == [r for r in a if r[0] == 3] or how == "monte_carlo"  # whose noise is that of all values
    assert run(table.filter("row = 3"), noise=0.1) == [r for r in run(table, noise=0.1) if r[0] == 3]
    assert all(lo <= risk <= hi and std > 0 for *_, risk, std, lo, hi in a)


def test_spread_of_slopes_is_that_of_the_formula():
    rng = np.random.default_rng(2)
    t = np.arange(60.0)
    v = 0.3 * t + rng.normal(0, 1, 60)
    line = v.mean() + resampling.slopes(t, v[None])[0] * (t - t.mean())
    gen = np.random.default_rng(3)
    drawn = resampling.slopes(t, line + (v - line)[gen.integers(0, 60, (4000, 60))])
    formula = np.sqrt(((v - line) ** 2).mean() / ((t - t.mean()) ** 2).sum())
    assert drawn.std() == pytest.approx(formula, rel=0.05) and drawn.mean() == pytest.approx(np.polyfit(t, v, 1)[0], abs=4 * formula / 60)
    noisy = resampling._drawn(t, v, "monte_carlo", 4000, 9, 0, 1.0)
    assert noisy.mean() == pytest.approx(abs(np.polyfit(t, v, 1)[0]) / np.sqrt(v.var() + 1), rel=0.02)


def test_intervals_cover_the_true_risk(spark):
    rng = np.random.default_rng(4)
    t = np.arange(80)
    truth = 0.02 / np.sqrt((0.02 * (t - t.mean())).var() + 0.25)
    data = [(p, 0, int(k), float(0.02 * k + rng.normal(0, 0.5))) for p in range(150) for k in t]
    got = resampling.drawn_risk(spark.createDataFrame(data, SERIES), ["row"], F.col("t"), replicates=400).collect()
    assert 0.85 <= np.mean([r["lo"] <= truth <= r["hi"] for r in got]) <= 1.0


def test_few_and_unknown_values(spark):
    data = [(1, 0, 0, 1.0), (1, 0, 1, 5.0), (2, 0, 0, None), (3, 0, None, 1.0), (4, 0, 0, float("nan")), (5, 0, 0, 1.0), (6, 0, 2, 1.0), (6, 0, 2, 2.0), (6, 0, 2, 4.0), (None, 0, 0, 1.0)]
    got = {r["row"]: (r["risk"], r["lo"], r["hi"]) for r in resampling.drawn_risk(spark.createDataFrame(data, SERIES), ["row"], F.col("t"), replicates=20).collect()}
    assert got == {k: (0.0, 0.0, 0.0) for k in (1, 5, 6, None)}
    assert resampling.drawn_risk(spark.createDataFrame([], SERIES), ["row"], F.col("t"), "monte_carlo").count() == 0
    with pytest.raises(ValueError):
        resampling.drawn_risk(spark.createDataFrame([], SERIES), ["row"], F.col("t"), "other")
