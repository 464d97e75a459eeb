"""Steps over many small scenes or pixels that are computed together, not one call each."""

from __future__ import annotations

import numpy as np

from geolathe.operators import unwrap


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_and_forests_take_many_scenes_a_call(spark):
    """Scenes of two boxes that lie 3, 100 and 300 columns apart are bridged in searches of their own reach."""
    apart = {s: (3, 100, 300)[s % 3] for s in range(60)}
    rows = [(s, r, c + k * (apart[s] + 2), 1.0, k + 1) for s in apart for k in (0, 1) for r in range(3) for c in range(3)]
    table = spark.createDataFrame(rows, "scene_id long, row int, col int, phase double, region int")
    assert "FlatMapGroups" not in _plan(unwrap.gaps(unwrap.border_pixels(table), 400))
    got = {r["scene_id"]: tuple(r)[1:] for r in unwrap.bridges(table).collect()}
    assert got == {s: (1, 2, float(d), 0, 2, 0, d + 2) for s, d in apart.items()}
    assert "FlatMapGroups" not in _plan(unwrap.bridge_cycles(table, 2, 4))
    assert unwrap.bridge_cycles(table, 2, 4).count() == 120


def test_cycles_of_many_pixels_are_those_of_each(monkeypatch):
    """All pixels in one call against a pixel at a time, with copies of pairs and pairs from a date to itself."""
    rng = np.random.default_rng(5)
    n = 1500
    pixel = np.sort(rng.integers(0, 60, n))
    d1, gap = rng.integers(0, 8, n), rng.integers(0, 4, n)
    level = rng.uniform(-9, 9, (60, 12))
    phase = level[pixel, d1 + gap] - level[pixel, d1] + 2 * np.pi * rng.choice((-2, -1, 0, 0, 0, 0, 1, 3), n)
    coherence = np.round(rng.random(n), 1)
    rounds = []
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: rounds.append(1) or bincount(*a))
    got = unwrap.whole_cycles(d1, d1 + gap, phase, coherence, pixel)
    assert np.count_nonzero(got) > 60 and len(rounds) < 60
    for k in range(60):
        i = np.flatnonzero(pixel == k)
        assert (got[i] == unwrap.whole_cycles(d1[i], (d1 + gap)[i], phase[i], coherence[i])).all()
