"""Queries of resampling and of offset fields, over rasters and orbits made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coregister as cr
from ..sources import tables as t
from . import geolocation as orbits
from .base import PIXELS, add, r6, sr

_c = F.col


def _mosaic(s, d) -> DataFrame:
    """Sixteen rasters as one of 32 x 32."""
    k = _c("scene_id")
    return t.rasters(s, d).select(F.floor(k / 16).alias("scene_id"), (F.floor(k % 16 / 4) * 8 + _c("row")).cast("int").alias("row"), (k % 4 * 8 + _c("col")).cast("int").alias("col"), "v")


_MOSAIC = f"(SELECT scene_id // 16 AS scene_id, scene_id % 16 // 4 * 8 + row AS row, scene_id % 4 * 8 + col AS col, v FROM {PIXELS})"
# places across the seams of tiles of 8, in eighths of a pixel
_AT_ROW, _AT_COL = "row + (row * 3 + col) % 16 / 8.0::DOUBLE - 1", "col + (row + col * 5) % 24 / 8.0::DOUBLE - 1.5"
_REQUESTS = f"(SELECT scene_id, row, col, {_AT_ROW} AS y, {_AT_COL} AS x FROM {_MOSAIC})"


def _requests(s, d) -> DataFrame:
    return _mosaic(s, d).select("scene_id", "row", "col", (_c("row") + (_c("row") * 3 + _c("col")) % 16 / 8.0 - 1).alias("at_row"), (_c("col") + (_c("row") + _c("col") * 5) % 24 / 8.0 - 1.5).alias("at_col"))


_TAP = "CASE WHEN {d} <= 1 THEN (1.5 * {d} - 2.5) * {d} * {d} + 1 WHEN {d} < 2 THEN ((-0.5 * {d} + 2.5) * {d} - 4) * {d} + 2 ELSE 0 END"
_TENT = "greatest(0, 1 - {d})"


def _gathered(tap: str, reach: int) -> str:
    w = f"({tap.format(d='abs(q.y - p.row)')}) * ({tap.format(d='abs(q.x - p.col)')})"
    need = f"(SELECT count(*) FROM range(-{reach}, {reach} + 1) a(i), range(-{reach}, {reach} + 1) b(j) WHERE ({tap.format(d='abs(q.y - floor(q.y) - i)')}) <> 0 AND ({tap.format(d='abs(q.x - floor(q.x) - j)')}) <> 0)"
    inner = f"SELECT q.scene_id, q.row, q.col, q.y, q.x, sum(p.v * {w}) AS v, count(*) FILTER ({w} <> 0) AS k FROM {_REQUESTS} q LEFT JOIN {_MOSAIC} p ON p.scene_id = q.scene_id AND abs(q.y - p.row) < {reach} AND abs(q.x - p.col) < {reach} GROUP BY ALL"
    return f"SELECT scene_id, row, col, CASE WHEN k = {need} THEN {sr('v')} END AS v FROM ({inner}) q"


for _kernel, _tap, _reach in (("cubic", _TAP, 2), ("linear", _TENT, 1)):
    add(f"resampled_{_kernel}", _gathered(_tap, _reach))(lambda s, d, k=_kernel: cr.resampled(_mosaic(s, d), _requests(s, d), kernel=k, tile=8).select("scene_id", "row", "col", r6(_c("v")).alias("v")))


# a ground point a part, seen by its orbit and the next one
def _frames(s, d) -> DataFrame:
    p = orbits._inside(s, d).filter("orbit < 3").select(_c("p_partkey").alias("scene_id"), "orbit", "time")
    side = lambda k, name, late: F.struct(F.lit(name).alias("side"), (_c("orbit") + k).alias("orbit"), (_c("time") - 1.0).alias("first_time"), F.lit(0.002).alias("row_s"), F.lit(800_000.0 + late).alias("near_range"), F.lit(2.5).alias("col_m"), (_c("time") + k).alias("center_time"))
    return p.select("scene_id", F.explode(F.array(side(0, "reference", 0.0), side(1, "secondary", 100.0))).alias("x")).select("scene_id", "x.*")


def _ground(s, d) -> DataFrame:
    k = _c("p_partkey")
    at = orbits._points(s, d).filter("orbit < 3")
    return at.select(k.alias("scene_id"), F.lit(1).alias("point"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.lit(120.0).alias("height"))


_LAT = "round(degrees(lat), 6)"
_E2 = 1 - (orbits.WGS84_B / orbits.WGS84_A) ** 2


def _offsets_sql() -> str:
    """The closed forms of both circles for the point at the rounded latitude and longitude, 120 m up."""
    fixed = f"list_reduce(list_prepend(atan2(pz, sqrt(px * px + py * py) * (1 - {_E2})), [CAST(0 AS DOUBLE) FOR i IN range(6)]), lambda a, b: atan2(pz + {_E2} * {orbits.WGS84_A} / sqrt(1 - {_E2} * sin(a) * sin(a)) * sin(a), sqrt(px * px + py * py)))"
    at = f"(SELECT p_partkey, orbit, time, radians(round(degrees({fixed}), 6)) AS la, radians(round(degrees(atan2(py, px)), 6)) AS lo FROM {orbits._located(f'(SELECT * FROM {orbits._PIXELS} {orbits._INSIDE})')} WHERE orbit < 3)"
    n = f"({orbits.WGS84_A} / sqrt(1 - {_E2} * sin(la) * sin(la)))"
    point = f"(SELECT *, ({n} + 120) * cos(la) * cos(lo) AS px, ({n} + 120) * cos(la) * sin(lo) AS py, ({n} * (1 - {_E2}) + 120) * sin(la) AS pz FROM {at})"
    (w0, f0), (w1, f1) = orbits._passed("orbit"), orbits._passed("orbit + 1")
    return f"SELECT p_partkey AS scene_id, round(({w0} - time + 1) / 0.002, 3) + 0.0 AS row, round(({f0} - 800000) / 2.5, 3) + 0.0 AS col, round(({w1} - {w0}) / 0.002, 3) + 0.0 AS d_row, round(({f1} - {f0} - 100) / 2.5, 3) + 0.0 AS d_col FROM {point}"


add("coregistration_geometry_offsets", _offsets_sql())(lambda s, d: cr.geometry_offsets(_ground(s, d), _frames(s, d), orbits._vectors(s, d)).select("scene_id", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("row", "col", "d_row", "d_col")]))


# control points of a supplier's lines: a plane by geometry, and measured ones off by another plane, some far off
def _controls(s, d) -> DataFrame:
    k, n = _c("l_suppkey"), _c("l_orderkey") * 7 + _c("l_linenumber")
    p = t.read(s, d, "lineitem").select(k.alias("scene_id"), (_c("l_linenumber") % 2 == 0).alias("measured"), (n % 997).cast("double").alias("row"), (n * 13 % 991).cast("double").alias("col"), (_c("l_orderkey") % 11 == 0).alias("wild"))
    more = F.when(_c("measured"), 0.5 + (_c("scene_id") % 3) * 0.001 * _c("row") + F.when(_c("wild"), 30.0).otherwise(0.0)).otherwise(0.0)
    return p.withColumns({"d_row": _c("scene_id") % 5 + 0.01 * _c("row") - 0.002 * _c("col") + more, "d_col": 2.0 - 0.003 * _c("row") + 0.004 * _c("col")})


add("coregistration_geometry_first", "SELECT DISTINCT l_suppkey AS scene_id, round(CAST(l_suppkey % 5 + 0.5 AS DOUBLE), 6) + 0.0 AS c0, round(CAST(0.01 + l_suppkey % 3 * 0.001 AS DOUBLE), 6) + 0.0 AS c_row, -0.002::DOUBLE AS c_col, 2.0::DOUBLE AS d0 FROM lineitem")(
    lambda s, d: cr.geometry_first(_controls(s, d), rounds=6).select("scene_id", *[r6(F.element_at("row_terms", i)).alias(n) for i, n in ((1, "c0"), (2, "c_row"), (3, "c_col"))], r6(F.element_at("col_terms", 1)).alias("d0"))
)


# mosaics whose second image is the first one, moved by whole pixels that the mosaic tells
def _images(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = _c("scene_id")
    ref = _mosaic(s, d).select("scene_id", "row", "col", _c("v").alias("re"), (_c("v") * F.sin(_c("row") * 3 + _c("col") * 5)).alias("im"))
    sec = ref.select("scene_id", (_c("row") + k % 3 - 1).alias("row"), (_c("col") + k % 5 - 2).alias("col"), "re", "im")
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.lit(float(r)).alias("row"), F.lit(float(c)).alias("col")) for n, (r, c) in enumerate(((14, 16), (16, 13), (17, 18)))]))
    points = ref.select("scene_id").distinct().withColumn("x", at).select("scene_id", "x.*", F.lit(0.0).alias("d_row"), F.lit(0.0).alias("d_col"))
    return points, ref, sec


add("coregistration_by_coherence", "SELECT scene_id, point, CAST(scene_id % 3 - 1 AS DOUBLE) AS d_row, CAST(scene_id % 5 - 2 AS DOUBLE) AS d_col, 1.0::DOUBLE AS coherence FROM (SELECT vec_id // 16 AS scene_id FROM embeddings GROUP BY 1 HAVING count(*) = 16), (SELECT unnest(range(3)) AS point)")(
    lambda s, d: cr.refined_by_coherence(*_images(s, d), window=8, coarse=2, fine=1.0, tile=16).select("scene_id", "point", *[r6(_c(c)).alias(c) for c in ("d_row", "d_col", "coherence")])
)
