"""Heights solved with motions against plain least squares, and selections against held-out dates against counts."""

from __future__ import annotations

import math

import numpy as np
import pytest

from geolathe.functions.geometry import WAVELENGTH_M
from geolathe.operators import inversion, series
from geolathe.sources import sinks

PAIRS = "pixel long, d1 int, d2 int, phase double, baseline double, coherence double"
TO_M = WAVELENGTH_M / (4 * math.pi)
LEVER = 1 / (850000.0 * math.sin(math.radians(35)))


def network(seed: int, own_baselines: bool):
    rng = np.random.default_rng(seed)
    days = np.cumsum(rng.integers(6, 30, 9))
    place = rng.normal(0, 80, len(days))
    rows = []
    for i in range(len(days)):
        for j in range(i + 1, min(i + 4, len(days))):
            b = rng.normal(0, 120) if own_baselines else place[j] - place[i]
            rows.append((seed, int(days[i]), int(days[j]), float(rng.normal(0, 2)), float(b), float(rng.uniform(0.3, 1))))
    return rows


def plain(rows):
    """(height, velocity) by one system of all dates and the height."""
    days = sorted({d for r in rows for d in r[1:3]})
    a = np.zeros((len(rows), len(days)))
    for k, (_, d1, d2, _, b, _) in enumerate(rows):
        for d, sign in ((d1, -1), (d2, 1)):
            if d != days[0]:
                a[k, days.index(d) - 1] += sign
        a[k, -1] = b * LEVER
    w = np.array([r[5] for r in rows])
    x = np.linalg.lstsq(a * w[:, None], np.array([r[3] for r in rows]) * TO_M * w, rcond=None)[0]
    t = np.array(days) / 365.25
    return x[-1], np.polyfit(t, np.concatenate(([0.0], x[:-1])), 1)[0]


def test_noisy_networks_as_by_one_system(spark):
    rows = {s: network(s, True) for s in range(1, 7)}
    got = {r.pixel: r for r in inversion.joint_series(spark.createDataFrame(sum(rows.values(), []), PAIRS), 850000.0, 35.0).collect()}
    for s, r in rows.items():
        height, velocity = plain(r)
        assert got[s].height == pytest.approx(height, rel=1e-8) and got[s].velocity == pytest.approx(velocity, rel=1e-8, abs=1e-12)


def test_baselines_that_are_differences_of_dates_tell_no_height(spark):
    got = inversion.joint_series(spark.createDataFrame(network(3, False) + [(9, 1, 5, None, 1.0, 0.5), (9, 1, 7, 1.0, None, 0.5)], PAIRS), 850000.0, 35.0).collect()
    alone = inversion.invert(spark.createDataFrame(network(3, False), PAIRS)).collect()
    assert [r.height for r in got] == [None]
    assert [r.velocity for r in got] == pytest.approx([r.velocity for r in alone], rel=1e-9)


def test_steady_motion_and_height_come_back(spark):
    rows = [(p, d1, d2, (0.03 * (d2 - d1) / 365.25 + b * LEVER * 12.5) / TO_M, b, c) for p, d1, d2, _, b, c in network(5, False)]
    still = [(6, 0, 10, 0.5, 10.0, 0.9), (6, 10, 30, 1.0, 20.0, 0.8)]  # years and baselines in proportion
    got = {r.pixel: r for r in inversion.joint_velocity(spark.createDataFrame(rows + still, PAIRS), 850000.0, 35.0).collect()}
    assert got[5].velocity == pytest.approx(0.03, rel=1e-9) and got[5].height == pytest.approx(12.5, rel=1e-9)
    assert got[6].velocity is None and got[6].height is None and got[6].n == 2


@pytest.mark.parametrize("share", [0.01, 0.1, 0.37, 1.0])
def test_top_share_by_counts(spark, share):
    rng = np.random.default_rng(2)
    rows = [("a", i, 0, float(v)) for i, v in enumerate(np.round(rng.normal(size=400), 1))] + [("b", i, 0, 1.0) for i in range(30)] + [("c", i, 0, None if i % 2 else float(i)) for i in range(50)]
    got = series.top_share(spark.createDataFrame(rows, "name string, row int, col int, score double"), "name", ("row", "col"), share).filter("picked").collect()
    for name in "abc":
        values = sorted((-1e300 if r[3] is None else r[3] for r in rows if r[0] == name), reverse=True)
        edge = values[max(1, int(len(values) * share)) - 1]
        assert sum(r.name == name for r in got) == sum(v >= edge for v in values)


def test_steady_pixels_keep_their_lead_on_held_out_dates(spark):
    """A block of steady pixels among noise: the selection finds it, stays coherent, and is clustered."""
    rng = np.random.default_rng(4)
    rows = []
    for s in range(14):
        for r in range(16):
            for c in range(16):
                firm = 4 <= r < 8 and 4 <= c < 8
                rows.append((s, r, c, float(5 + rng.normal(0, 0.05 if firm else 2)), float(0.3 + rng.normal(0, 0.05) if firm else rng.uniform(-math.pi, math.pi))))
    stack = spark.createDataFrame(rows, "scene_id int, row int, col int, v double, phase double")
    got = {r.name: r for r in series.holdout(stack, n_eval=4, share=16 / 256, k=3).collect()}
    assert got["adi"].n == 16 and got["adi"].held_out > 0.95 and got["adi"].held_out_minus_random > 0.3
    assert got["adi"].neighbour_ratio == pytest.approx((4 * 3 + 8 * 5 + 4 * 8) / 16 / (8 * 16 / 256))
    assert series.holdout(stack.filter("scene_id < 5"), n_eval=3).count() == 0


def test_selected_points_as_csv(spark, tmp_path):
    rows = [(0, 0, True, 0.5), (3, 4, True, 0.25), (5, 5, False, 0.1), (6, 6, None, 0.1)]
    s = spark.createDataFrame(rows, "row int, col int, picked boolean, score double")
    sinks.export_points(s, f"{tmp_path}/p", transform=(0.5, 0.0, 10.0, 0.0, -0.5, 50.0))
    got = spark.read.csv(f"{tmp_path}/p", header=True, inferSchema=True).orderBy("stack_row").collect()
    assert [tuple(r) for r in got] == [(0.5, 1.5, 0, 0, 0.5, 10.25, 49.75), (3.5, 13.5, 3, 4, 0.25, 12.25, 48.25)]
    assert sinks.selected_points(s, looks=(2, 2)).columns == ["crop_row", "crop_col", "stack_row", "stack_col", "score"]
    assert sinks.selected_points(s, transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), geographic=False).columns[-2:] == ["x", "y"]
