"""Burst ramps against plain formulas and planted signals; split bands against planted dispersion."""

from __future__ import annotations

import math

import numpy as np
import pytest

from geolathe.operators import ramps, splitband
from geolathe.sources import products

LINES, SAMPLES, DT, TAU0, RATE, FREQ, STEER = 80, 400, 0.01, 0.0053, 6.4e7, 5.405e9, math.radians(1.59)
SWATH = "scene_id long, lines int, samples int, dt double, tau0 double, rate double, frequency double, steering double"
FM = [(0.0, 0.0053, [-2300.0, 4.0e5, -5.0e7]), (0.3, 0.0053, [-2290.0, 4.1e5, -5.1e7])]
DC = [(0.1, 0.0054, [30.0, -2.0e4, 1.0e6]), (0.5, 0.0054, [20.0, -1.0e4, 2.0e6])]
SPEEDS = [(-1.0, 7400.0), (1.0, 7800.0)]
STARTS = [-0.4, 0.0, 0.3]


def terms(spark):
    swaths = spark.createDataFrame([(1, LINES, SAMPLES, DT, TAU0, RATE, FREQ, STEER)], SWATH)
    bursts = spark.createDataFrame([(1, i, s) for i, s in enumerate(STARTS)], "scene_id long, burst int, start double")
    poly = spark.createDataFrame([(1, k, *p) for k, ps in (("fm", FM), ("dc", DC)) for p in ps], "scene_id long, kind string, time double, t0 double, c array<double>")
    return ramps.burst_terms(swaths, bursts, poly, spark.createDataFrame([(1, *v) for v in SPEEDS], "scene_id long, time double, speed double"))


def ramp(row: float, col: float) -> float:
    b = min(max(int(row // LINES), 0), len(STARTS) - 1)
    mid = STARTS[b] + LINES * DT / 2
    at = lambda ps, tau: (lambda p: sum(c * (tau - p[1]) ** k for k, c in enumerate(p[2])))(min(ps, key=lambda p: abs(p[0] - mid)))
    speed = 7400 + (mid + 1) / 2 * 400
    ks = 2 * speed * FREQ / 299792458.0 * STEER
    tau, middle = TAU0 + col / RATE, TAU0 + SAMPLES / 2 / RATE
    kt = ks / (1 - ks / at(FM, tau))
    d = (row - b * LINES - LINES / 2) * DT - (-at(DC, tau) / at(FM, tau) + at(DC, middle) / at(FM, middle))
    return math.pi * kt * d * d + 2 * math.pi * at(DC, tau) * d


def test_ramp_at_places(spark):
    rows = [(1, r + 0.25 * k, c * 1.5) for r in range(-3, 260, 17) for c in range(0, 260, 37) for k in range(2)]
    got = ramps.with_ramp(spark.createDataFrame(rows, "scene_id long, row double, col double"), terms(spark)).collect()
    assert len(got) == len(rows)
    assert all(g.ramp == pytest.approx(ramp(g.row, g.col), abs=1e-9) for g in got)


@pytest.mark.parametrize("sign", [1, -1])
def test_planted_ramp_is_told_and_taken_off(spark, sign):
    rng = np.random.default_rng(0)
    rows = []
    for c in (10, 200, 390):
        base = np.exp(1j * np.cumsum(rng.normal(0, 0.2, 3 * LINES)))
        rows += [(1, r, c, *(lambda z: (z.real, z.imag))(base[r] * np.exp(1j * sign * ramp(r, c)))) for r in range(3 * LINES)]
    p = spark.createDataFrame([(s, r, c, float(a), float(b)) for s, r, c, a, b in rows], "scene_id long, row int, col int, re double, im double")
    got = ramps.sign_scores(p, terms(spark)).collect()
    assert [(g.sign, g.clear) for g in got] == [(sign, True)] and max(got[0].plus, got[0].minus) > 0.9
    flat = ramps.turned(ramps.with_ramp(p, terms(spark), sign), -ramps.F.col("ramp")).filter("col = 10").orderBy("row").collect()
    first = np.random.default_rng(0)
    want = np.exp(1j * np.cumsum(first.normal(0, 0.2, 3 * LINES)))
    assert np.abs(np.array([f.re + 1j * f.im for f in flat]) - want).max() < 1e-6


def test_too_few_lines_have_no_sign(spark):
    p = spark.createDataFrame([(1, r, 0, 1.0, 0.0) for r in range(20)], "scene_id long, row int, col int, re double, im double")
    assert [(g.plus, g.sign, g.clear) for g in ramps.sign_scores(p, terms(spark)).collect()] == [(None, None, None)]


def test_annotation_polynomials(spark):
    text = "<product><swathTiming><linesPerBurst>1500</linesPerBurst><samplesPerBurst>20000</samplesPerBurst></swathTiming><azimuthTimeInterval>2.0e-3</azimuthTimeInterval><slantRangeTime>5.3e-3</slantRangeTime><rangeSamplingRate>6.4e7</rangeSamplingRate><radarFrequency>5.405e9</radarFrequency><azimuthSteeringRate>90</azimuthSteeringRate>"
    new = text + "<l><azimuthFmRate><azimuthTime>2024-01-01T00:00:01.5</azimuthTime><t0>5.3e-3</t0><azimuthFmRatePolynomial count='3'>-2300 4e5 -5e7</azimuthFmRatePolynomial></azimuthFmRate></l><d><dcEstimate><azimuthTime>2024-01-01T00:00:02</azimuthTime><t0>5.4e-3</t0><dataDcPolynomial>30 -2e4</dataDcPolynomial></dcEstimate></d></product>"
    old = text + "<l><azimuthFmRate><azimuthTime>2014-01-01T00:00:01</azimuthTime><t0>5.3e-3</t0><c0>-2300</c0><c1>4e5</c1><c2>-5e7</c2></azimuthFmRate></l></product>"
    files = spark.createDataFrame([("new", new), ("old", old), ("none", "<x/>"), ("null", None)], "file string, content string")
    got = {(r.file, r.kind): (str(r.time), r.t0, r.c) for r in products.range_polynomials(files).collect()}
    assert got == {("new", "fm"): ("2024-01-01 00:00:01.500000", 5.3e-3, [-2300.0, 4e5, -5e7]), ("new", "dc"): ("2024-01-01 00:00:02", 5.4e-3, [30.0, -2e4]), ("old", "fm"): ("2014-01-01 00:00:01", 5.3e-3, [-2300.0, 4e5, -5e7])}
    s = products.swaths(files).collect()
    assert [(r.file, r.lines, r.samples, r.rate) for r in s] == [("new", 1500, 20000, 6.4e7), ("old", 1500, 20000, 6.4e7)] and s[0].steering == pytest.approx(math.pi / 2)


PIX = "scene_id long, row int, col int, ref_re double, ref_im double, sec_re double, sec_im double"


def pair(low: float, high: float, h: int = 24, w: int = 64, noise: float = 0.0):
    """Lines of noise whose lower and upper bands have planted phases in the second image."""
    rng = np.random.default_rng(3)
    ref = rng.normal(size=(h, w)) + 1j * rng.normal(size=(h, w))
    spectrum, f = np.fft.fft(ref, axis=1), np.fft.fftfreq(w)
    sec = np.fft.ifft(spectrum * np.exp(-1j * np.where(f < 0, low, high)), axis=1)
    sec += noise * (rng.normal(size=(h, w)) + 1j * rng.normal(size=(h, w)))
    return [(5, r, c, ref[r, c].real, ref[r, c].imag, sec[r, c].real, sec[r, c].imag) for r in range(h) for c in range(w)]


def rows_of(spark, rows):
    return spark.createDataFrame([(s, r, c, *map(float, v)) for s, r, c, *v in rows], PIX)


@pytest.mark.parametrize("low,high", [(0.4, 1.3), (0.7, 0.7)])
def test_planted_dispersion_comes_back(spark, low, high):
    got = splitband.dispersive(rows_of(spark, pair(low, high)), 1.0, 0.9).collect()
    assert len(got) == 24 * 64
    assert max(abs(g.phase - (high - low)) for g in got) < 1e-9 and min(g.coherence for g in got) > 1 - 1e-9
    s = splitband.summary(splitband.dispersive(rows_of(spark, pair(low, high)), 1.0, 0.9)).collect()
    assert s[0].mean_magnitude == pytest.approx(high - low, abs=1e-9)


def test_noise_is_not_steady(spark):
    got = splitband.dispersive(rows_of(spark, pair(0.0, 0.5, noise=20.0)), 1.0, 0.9).collect()
    assert np.mean([g.coherence for g in got]) < 0.7


def test_unknown_samples_have_no_value(spark):
    rows = pair(0.1, 0.4)
    rows[100] = (*rows[100][:3], None, *rows[100][4:])
    df = spark.createDataFrame([(s, r, c, *[None if x is None else float(x) for x in v]) for s, r, c, *v in rows if not (r == 5 and c == 9)], PIX)
    got = {(g.row, g.col): g for g in splitband.dispersive(df, 1.0, 0.9).collect()}
    assert len(got) == 24 * 64 - 1 and (5, 9) not in got
    r, c = rows[100][1], rows[100][2]
    assert got[r, c].phase is None and got[r, c].coherence is None and got[r, (c + 8) % 64].phase is not None
