"""Queries of burst ramps over swaths made from the suppliers, and of split bands over the rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ramps, splitband
from ..sources import tables as t
from .base import PAIRS, add, box, r6, sr

_c = F.col
_LINES, _SAMPLES, _DT, _TAU0, _RATE, _FREQ, _STEER = 64, 400, 0.01, 0.0053, 6.4e7, 5.405e9, 0.0277507


def _terms(s, d, scenes: DataFrame, bursts: int) -> DataFrame:
    """Ramps whose polynomials depend on the scene and the time."""
    k = _c("scene_id")
    swaths = scenes.select(k, *[F.lit(v).alias(n) for n, v in (("lines", _LINES), ("samples", _SAMPLES), ("dt", _DT), ("tau0", _TAU0), ("rate", _RATE), ("frequency", _FREQ), ("steering", _STEER))])
    b = scenes.select(k, F.explode(F.sequence(F.lit(0), F.lit(bursts - 1))).alias("burst")).withColumn("start", _c("burst") * 2.5)
    at = scenes.select(k, F.explode(F.sequence(F.lit(0), F.lit(bursts - 1))).alias("n"))
    fm = at.select(k, F.lit("fm").alias("kind"), (_c("n") * 2.0).alias("time"), F.lit(_TAU0).alias("t0"), F.array(-2300.0 - k % 50 + _c("n"), F.lit(4.0e5), F.lit(-5.0e7)).alias("c"))
    dc = at.select(k, F.lit("dc"), _c("n") * 3.0 + 0.1, F.lit(_TAU0), F.array(30.0 + k % 7 - _c("n"), F.lit(-2.0e4)))
    speeds = scenes.select(k, F.explode(F.array(*[F.struct(F.lit(x).alias("time"), (7500.0 + 2 * x + k % 11).alias("speed")) for x in (-10.0, 40.0)])).alias("x")).select(k, "x.*")
    return ramps.burst_terms(swaths, b, fm.union(dc), speeds)


def _ramp_sql(rows: str, bursts: int) -> str:
    """``rows`` (scene_id, row, col, ...) with ramp."""
    last = bursts - 1
    b = f"SELECT *, greatest(0, least({last}, CAST(floor(row / {_LINES}.0) AS INT))) AS b FROM {rows}"
    m = f"SELECT *, b * 2.5 + {_LINES * _DT / 2} AS mid, {_TAU0} + col / {_RATE} AS tau FROM ({b})"
    # the polynomial nearest to the burst's middle
    n = f"SELECT *, (SELECT arg_min(i, (abs(i * 2.0 - mid), i)) FROM range({bursts}) r(i)) AS f, (SELECT arg_min(i, (abs(i * 3.0 + 0.1 - mid), i)) FROM range({bursts}) r(i)) AS g, 2 * (7500.0 + 2 * mid + scene_id % 11) * {_FREQ} / 299792458.0 * {_STEER} AS ks FROM ({m})"
    ka = lambda x: f"(-2300.0 - scene_id % 50 + f + 4.0e5 * ({x}) - 5.0e7 * ({x}) * ({x}))"
    dc = lambda x: f"(30.0 + scene_id % 7 - g - 2.0e4 * ({x}))"
    x, mid = f"tau - {_TAU0}", f"{_SAMPLES / 2 / _RATE}"
    e = f"SELECT *, (row - b * {_LINES} - {_LINES / 2}) * {_DT} + {dc(x)} / {ka(x)} - {dc(mid)} / {ka(mid)} AS e, ks / (1 - ks / {ka(x)}) AS kt, {dc(x)} AS fdc FROM ({n})"
    return f"(SELECT *, pi() * kt * e * e + 2 * pi() * fdc * e AS ramp, fdc + kt * e AS doppler FROM ({e}))"


_LINE = "(SELECT l_suppkey AS scene_id, l_orderkey, l_linenumber, CAST(l_orderkey % 700 AS DOUBLE) + l_linenumber / 8.0 AS row, CAST(l_partkey % 399 AS DOUBLE) + 0.5 AS col FROM lineitem)"
add("burst_ramp_phase", f"SELECT l_orderkey, l_linenumber, {sr('ramp')} AS ramp, {sr('doppler')} AS doppler FROM {_ramp_sql(_LINE, 9)}")(
    lambda s, d: ramps.with_ramp(
        t.read(s, d, "lineitem").select(_c("l_suppkey").alias("scene_id"), "l_orderkey", "l_linenumber", ((_c("l_orderkey") % 700).cast("double") + _c("l_linenumber") / 8.0).alias("row"), ((_c("l_partkey") % 399).cast("double") + 0.5).alias("col")),
        _terms(s, d, t.read(s, d, "lineitem").select(_c("l_suppkey").alias("scene_id")).distinct(), 9),
    ).select("l_orderkey", "l_linenumber", r6(_c("ramp")).alias("ramp"), r6(_c("doppler")).alias("doppler"))
)


def _signed(s, d) -> tuple[DataFrame, DataFrame]:
    """Scenes of eight rasters, a burst of 64 lines, with the ramp of the scene's sign on calm phases; and their terms."""
    k = _c("scene_id")
    p = t.rasters(s, d).select(F.floor(k / 8).alias("scene_id"), (k % 8 * 8 + _c("row")).cast("int").alias("row"), "col", (_c("v") * 2).alias("a"))
    terms = _terms(s, d, p.select("scene_id").distinct(), 1)
    at = _c("a") + _c("ramp") * F.when(k % 2 == 0, 1).otherwise(-1)
    return ramps.with_ramp(p, terms).select("scene_id", "row", "col", F.cos(at).alias("re"), F.sin(at).alias("im")), terms


add("burst_ramp_sign", "SELECT scene_id, CAST(CASE WHEN scene_id % 2 = 0 THEN 1 ELSE -1 END AS INT) AS sign, true AS clear FROM (SELECT vec_id // 8 AS scene_id FROM embeddings GROUP BY 1 HAVING count(*) = 8)")(
    lambda s, d: ramps.sign_scores(*_signed(s, d)).filter("sign IS NOT NULL").select("scene_id", "sign", "clear")
)

# the lines of two rasters as one complex line of eight samples, eight hertz apart: the thirds of a band of six hold three frequencies each
_KERNEL = "(SELECT side, n, sum(cos(2 * pi() * f * n / 8)) / 8 AS c, sum(sin(2 * pi() * f * n / 8)) / 8 AS s FROM (VALUES (0, -3), (0, -2), (0, -1), (1, 1), (1, 2), (1, 3)) AS k(side, f), range(-7, 8) AS o(n) GROUP BY side, n)"
_BAND = f"(SELECT a.scene_id, a.row, a.col, k.side, sum(b.a * k.c - b.b * k.s) AS pr, sum(b.a * k.s + b.b * k.c) AS pi, sum((b.a + 3 * b.b * b.b) * k.c - (b.b / 2 + 3 * b.a * b.a) * k.s) AS qr, sum((b.a + 3 * b.b * b.b) * k.s + (b.b / 2 + 3 * b.a * b.a) * k.c) AS qi FROM {PAIRS} a JOIN {PAIRS} b ON a.scene_id = b.scene_id AND a.row = b.row JOIN {_KERNEL} k ON k.n = a.col - b.col GROUP BY ALL)"
_IFGS = f"(SELECT scene_id, row, col, side, pr * qr + pi * qi AS re, pi * qr - pr * qi AS im, sqrt((pr * pr + pi * pi) * (qr * qr + qi * qi)) AS m FROM {_BAND})"
_DD = f"(SELECT h.scene_id, h.row, h.col, h.re * l.re + h.im * l.im AS re, h.im * l.re - h.re * l.im AS im, h.m * l.m AS w FROM {_IFGS} h JOIN {_IFGS} l USING (scene_id, row, col) WHERE h.side = 1 AND l.side = 0)"
_STEADY = box("SELECT * FROM dd", "any_value(a.re) AS re, any_value(a.im) AS im, sqrt(avg(b.re) * avg(b.re) + avg(b.im) * avg(b.im)) / greatest(avg(b.w), 1e-10) AS coherence", 5)
add("split_band_double_difference", f"WITH dd AS MATERIALIZED {_DD} SELECT scene_id, row, col, {sr('re * 1e4')} AS re, {sr('im * 1e4')} AS im, {sr('coherence')} AS coherence FROM ({_STEADY})")(
    lambda s, d: splitband.dispersive(t.raster_pairs(s, d).select("scene_id", "row", "col", _c("a").alias("ref_re"), _c("b").alias("ref_im"), (_c("a") + 3 * _c("b") * _c("b")).alias("sec_re"), (_c("b") / 2 + 3 * _c("a") * _c("a")).alias("sec_im")), 8.0, 6.0).select("scene_id", "row", "col", r6(_c("re") * 1e4).alias("re"), r6(_c("im") * 1e4).alias("im"), r6(_c("coherence")).alias("coherence"))
)
