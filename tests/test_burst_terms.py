"""Terms of bursts from all rows of a scene at once."""

from __future__ import annotations

from geolathe.operators import ramps


def _terms(spark, speeds):
    swaths = spark.createDataFrame([(k, 100, 400, 0.01, 0.005, 6e7, 5.4e9, 0.02) for k in (1, 2, 3)], "scene_id long, lines int, samples int, dt double, tau0 double, rate double, frequency double, steering double")
    bursts = spark.createDataFrame([(1, 1, 3.0), (1, 0, 0.0), (2, 0, 0.0), (9, 0, 0.0)], "scene_id long, burst int, start double")
    c = [float(-2000 - i) for i in range(4)]
    polynomials = spark.createDataFrame(
        [(1, "fm", 0.0, 0.005, [c[0]]), (1, "fm", 1.0, 0.005, [c[1]]), (1, "fm", 9.0, 0.005, [c[2]]), (1, "dc", 3.4, 0.005, [30.0]), (2, "fm", 0.0, 0.005, [c[3]])], "scene_id long, kind string, time double, t0 double, c array<double>"
    )
    speed = spark.createDataFrame([(1, 0.0, 7000.0), (1, 1.0, 7100.0)], "scene_id long, time double, speed double") if speeds else None
    return ramps.burst_terms(swaths, bursts, polynomials, speed)


def test_terms_of_a_scene(spark):
    for speeds in (True, False):
        got = {r["scene_id"]: r["bursts"] for r in _terms(spark, speeds).collect()}
        assert set(got) == {1, 2}  # scenes without bursts or without a swath have none
        a, b = got[1]
        assert (a["burst"], a["mid"], b["burst"], b["mid"]) == (0, 0.5, 1, 3.5)
        assert a["fm"] == [-2000.0] and b["fm"] == [-2001.0] and a["dc"] == [30.0]  # the earlier of equals; the nearest
        for one, v in ((a, 7050.0 if speeds else ramps.SPEED), (b, 7100.0 if speeds else ramps.SPEED)):
            assert abs(one["steering"] - 2 * v * 5.4e9 / ramps.LIGHT * 0.02) < 1e-9
        assert abs(a["center"] - 30.0 / 2000) < 1e-12
        assert got[2][0]["dc"] is None and got[2][0]["center"] is None


def test_a_scene_meets_its_swath_in_one_join(spark):
    plan = _terms(spark, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1
