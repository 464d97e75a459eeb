"""Queries of flow over elevation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hydrology as hy
from ..sources import tables as t
from .base import KEY, PIXELS, add, pixel_query, r6, sr

_D8 = "(VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) AS o(i, dr, dc)"
_DIR = f"(SELECT scene_id, row, col, max(z) AS z, arg_min(dr, (-z, i)) AS dr, arg_min(dc, (-z, i)) AS dc FROM (SELECT a.scene_id, a.row, a.col, o.i, o.dr, o.dc, (a.v - b.v) / sqrt(o.dr * o.dr + o.dc * o.dc) AS z FROM {PIXELS} a, {_D8}, {PIXELS} b WHERE b.scene_id = a.scene_id AND b.row = a.row + o.dr AND b.col = a.col + o.dc) GROUP BY ALL)"
_WALK = f"dirs AS MATERIALIZED (SELECT * FROM {_DIR}), walk AS (SELECT scene_id, row, col FROM {PIXELS} UNION ALL SELECT w.scene_id, CAST(w.row + d.dr AS INT), CAST(w.col + d.dc AS INT) FROM walk w JOIN dirs d ON w.scene_id = d.scene_id AND w.row = d.row AND w.col = d.col AND d.z > 0)"
_ACC = f"WITH RECURSIVE {_WALK} SELECT scene_id, row, col, count(*) AS acc FROM walk GROUP BY ALL"
add("flow_accumulation", _ACC)(lambda s, d: hy.accumulation(t.rasters(s, d)))
_line = lambda p, o: f"OVER (PARTITION BY scene_id, {p} ORDER BY {o})"
_g = lambda p, o: f"CASE WHEN lag(v) {_line(p, o)} IS NULL THEN lead(v) {_line(p, o)} - v WHEN lead(v) {_line(p, o)} IS NULL THEN v - lag(v) {_line(p, o)} ELSE (lead(v) {_line(p, o)} - lag(v) {_line(p, o)}) / 2 END"
_SLOPE = f"(SELECT scene_id, row, col, greatest(atan(sqrt(zx * zx + zy * zy)), radians(0.1)) AS slope FROM (SELECT *, {_g('row', 'col')} AS zx, {_g('col', 'row')} AS zy FROM {PIXELS}))"
add("topographic_wetness", f"WITH RECURSIVE {_WALK} SELECT a.scene_id, a.row, a.col, {sr('ln(acc / tan(slope))')} AS twi FROM (SELECT scene_id, row, col, count(*) AS acc FROM walk GROUP BY ALL) a JOIN {_SLOPE} s ON a.scene_id = s.scene_id AND a.row = s.row AND a.col = s.col")(lambda s, d: hy.wetness(t.rasters(s, d)).withColumn("twi", r6(F.col("twi"))))
add("drainage_network", f"WITH RECURSIVE {_WALK}, a AS (SELECT scene_id, row, col, count(*) AS acc FROM walk GROUP BY ALL) SELECT a.scene_id, a.row, a.col, acc >= least AS stream FROM a JOIN (SELECT scene_id, quantile_cont(acc, 0.9) AS least FROM a GROUP BY scene_id) q ON a.scene_id = q.scene_id")(
    lambda s, d: hy.drainage(hy.accumulation(t.rasters(s, d)), share=0.9).select("scene_id", "row", "col", "stream")
)
# a cell's level: the lowest over the levels that occur of those at which it has a way to the border under water
_FILL = f"""WITH RECURSIVE px AS MATERIALIZED (SELECT scene_id, row, col, v FROM {PIXELS} WHERE scene_id % 10 = 0 OR true),
reach AS (SELECT scene_id, row, col, v AS f, 0 AS step FROM px WHERE row IN (0, 7) OR col IN (0, 7)
 UNION SELECT p.scene_id, p.row, p.col, min(greatest(p.v, r.f)), r.step + 1 FROM reach r JOIN px p ON p.scene_id = r.scene_id AND abs(p.row - r.row) <= 1 AND abs(p.col - r.col) <= 1 AND NOT (p.row = r.row AND p.col = r.col) AND p.row BETWEEN 1 AND 6 AND p.col BETWEEN 1 AND 6 WHERE r.step < 24 GROUP BY p.scene_id, p.row, p.col, r.step)
SELECT p.scene_id, p.row, p.col, {sr('f')} AS filled, {sr('CASE WHEN f - v >= 0.1 THEN f - v ELSE 0 END')} AS depth FROM px p JOIN (SELECT scene_id, row, col, min(f) AS f FROM reach GROUP BY ALL) m ON p.scene_id = m.scene_id AND p.row = m.row AND p.col = m.col""".replace(" WHERE scene_id % 10 = 0 OR true", "")
add("depressions", _FILL)(lambda s, d: hy.depressions(t.rasters(s, d)).select("scene_id", "row", "col", r6(F.col("filled")).alias("filled"), r6(F.col("depth")).alias("depth")))
_V = f"(SELECT scene_id, row, col, CAST(trunc(v) AS BIGINT) AS value, row * 67108864 + col AS f FROM {PIXELS})"
add("value_regions", f"""WITH RECURSIVE px AS MATERIALIZED (SELECT * FROM {_V}),
grown AS (SELECT scene_id, row, col, value, f FROM px UNION SELECT p.scene_id, p.row, p.col, p.value, g.f FROM grown g JOIN px p ON p.scene_id = g.scene_id AND p.value = g.value AND abs(p.row - g.row) + abs(p.col - g.col) = 1 AND g.f < p.f),
named AS (SELECT scene_id, row, col, value, min(f) AS region FROM grown GROUP BY ALL)
SELECT scene_id, row, col, value, CAST(region AS BIGINT) AS region, count(*) OVER (PARTITION BY scene_id, region) AS area FROM named""")(lambda s, d: hy.regions(t.rasters(s, d)))
