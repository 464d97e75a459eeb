"""Queries of polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as ve
from ..sources import tables as t
from .base import POINTS, SCENES, add, r6, sr

_c = F.col
# a polygon of each nation: a box with its lower right corner pulled in and a spike above
_X0, _Y0 = "(n_nationkey * 14 - 180)", "(n_nationkey * 37 % 130 - 70)"
_PTS = [(f"{_X0} + 0.0", f"{_Y0} + 0.0"), (f"{_X0} + 18.0", f"{_Y0} + 5.0"), (f"{_X0} + 20.0", f"{_Y0} + 30.0"), (f"{_X0} + 9.0", f"{_Y0} + 44.5"), (f"{_X0} + 1.0", f"{_Y0} + 28.0")]
_SIDES = "(SELECT n_nationkey, unnest([" + ", ".join(f"{{'x1': {a[0]}, 'y1': {a[1]}, 'x2': {b[0]}, 'y2': {b[1]}}}" for a, b in zip(_PTS, _PTS[1:] + _PTS[:1])) + "], recursive := true) FROM nation)"


def _zones(s, d):
    return t.read(s, d, "nation").select("n_nationkey", ve.ring(*[(F.expr(x), F.expr(y)) for x, y in _PTS]).alias("ring"))


_T = "(x1 * y2 - x2 * y1)"
add("polygon_metrics", f"SELECT n_nationkey, {sr(f'abs(sum({_T})) / 2')} AS area, {sr('sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))')} AS perimeter, {sr(f'4 * pi() * (abs(sum({_T})) / 2) / (pow(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 2) + 1e-10)')} AS compactness FROM {_SIDES} GROUP BY n_nationkey")(
    lambda s, d: _zones(s, d).select("n_nationkey", *[r6(v).alias(k) for k, v in ve.measures(_c("ring")).items()])
)
add("polygon_centroids", f"SELECT n_nationkey, {sr(f'sum((x1 + x2) * {_T}) / (3 * sum({_T}))')} AS cx, {sr(f'sum((y1 + y2) * {_T}) / (3 * sum({_T}))')} AS cy FROM {_SIDES} GROUP BY n_nationkey")(lambda s, d: _zones(s, d).select("n_nationkey", *[r6(v).alias(k) for k, v in ve.centroid(_c("ring")).items()]))
_IN = f"(SELECT p.c_custkey, s.n_nationkey, any_value(p.c_acctbal) AS bal, count(*) % 2 = 1 AS inside FROM {POINTS} p, {_SIDES} s WHERE (s.y1 > p.lat) <> (s.y2 > p.lat) AND p.lon < (s.x2 - s.x1) * (p.lat - s.y1) / nullif(s.y2 - s.y1, 0) + s.x1 GROUP BY ALL)".replace(", any_value(p.c_acctbal) AS bal", ", p.c_acctbal AS bal")
add("polygon_point_join", f"SELECT n_nationkey, count(*) AS n, {sr('sum(bal)')} AS total FROM {_IN} WHERE inside GROUP BY n_nationkey")(
    lambda s, d: ve.join_points(t.points(s, d), _zones(s, d), 20.0, x="lon", y="lat").groupBy("n_nationkey").agg(F.count("*").alias("n"), r6(F.sum("c_acctbal")).alias("total"))
)
add("polygon_point_join_left", f"SELECT p.c_custkey, count(i.n_nationkey) AS zones FROM {POINTS} p LEFT JOIN (SELECT * FROM {_IN} WHERE inside) i ON p.c_custkey = i.c_custkey GROUP BY p.c_custkey")(
    lambda s, d: ve.join_points(t.points(s, d), _zones(s, d), 20.0, "left", "lon", "lat").groupBy("c_custkey").agg(F.count("n_nationkey").alias("zones"))
)
_BOXES = f"(SELECT n_nationkey, min(x1) AS bx0, min(y1) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM {_SIDES} GROUP BY n_nationkey)"


def _boxed(s, d):
    z = _zones(s, d)
    return z.select("n_nationkey", *[v.alias(n) for v, n in zip(ve.envelope(_c("ring")), ("bx0", "by0", "bx1", "by1"))])


add("bbox_overlap_join", f"SELECT n_nationkey, count(*) AS n FROM {SCENES} s JOIN {_BOXES} b ON s.min_lon <= bx1 AND bx0 <= s.max_lon AND s.min_lat <= by1 AND by0 <= s.max_lat GROUP BY n_nationkey")(
    lambda s, d: ve.join_boxes(t.scenes(s, d).select("id", _c("min_lon").alias("ax0"), _c("min_lat").alias("ay0"), _c("max_lon").alias("ax1"), _c("max_lat").alias("ay1")), _boxed(s, d), 10.0).groupBy("n_nationkey").agg(F.count("*").alias("n"))
)
add("polygon_buffer_box", f"SELECT n_nationkey, min(x1) - 2.5 AS x0, max(y1) + 2.5 AS y1 FROM {_SIDES} GROUP BY n_nationkey")(lambda s, d: _zones(s, d).withColumn("e", F.array(*ve.envelope(ve.widened(_c("ring"), 2.5)))).select("n_nationkey", _c("e")[0].alias("x0"), _c("e")[3].alias("y1")))
# two boxes, whose overlap SQL knows
_A, _B = ("bx0", "by0", "bx1", "by1"), ("bx0 + 6.0", "by0 - 11.0", "bx0 + 40.0", "by0 + 20.0")
_AREA = lambda b: f"(({b[2]}) - ({b[0]})) * (({b[3]}) - ({b[1]}))"
_BOTH = f"greatest(0.0, least({_A[2]}, {_B[2]}) - greatest({_A[0]}, {_B[0]})) * greatest(0.0, least({_A[3]}, {_B[3]}) - greatest({_A[1]}, {_B[1]}))"
_pair = lambda s, d: _boxed(s, d).select("n_nationkey", ve.box_ring(*map(F.expr, _A)).alias("a"), ve.box_ring(*map(F.expr, _B)).alias("b"))
for _h, _e in {"intersection": _BOTH, "union": f"{_AREA(_A)} + {_AREA(_B)} - {_BOTH}", "difference": f"{_AREA(_A)} - {_BOTH}", "symmetric_difference": f"{_AREA(_A)} + {_AREA(_B)} - 2 * {_BOTH}"}.items():
    add(f"overlay_{_h}", f"SELECT n_nationkey, {sr(_e)} AS area FROM {_BOXES}")(lambda s, d, h=_h: ve.overlaid(_pair(s, d), h).select("n_nationkey", r6(_c("area")).alias("area")))
# a box with corners in the middle of its sides, which simplification takes away
_MID = lambda: ve.ring((_c("bx0"), _c("by0")), ((_c("bx0") + _c("bx1")) / 2, _c("by0") + 0.001), (_c("bx1"), _c("by0")), (_c("bx1"), _c("by1")), ((_c("bx0") + _c("bx1")) / 2, _c("by1") + 3.0), (_c("bx0"), _c("by1")))
add("simplify_rings", "SELECT n_nationkey, 5 AS corners FROM nation")(lambda s, d: _boxed(s, d).withColumn("r", ve.simplified(_MID(), 0.5)).select("n_nationkey", F.size("r").alias("corners")))
