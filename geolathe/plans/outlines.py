"""Queries of the outlines of regions: what a ring adds up to is counted from the cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hydrology as hy
from ..operators import outlines as ol
from ..sources import tables as t
from .base import PIXELS, add

_REGIONS = f"""RECURSIVE px AS MATERIALIZED (SELECT scene_id, row, col, CAST(trunc(v * 8) AS BIGINT) AS value, row * 67108864 + col AS f FROM {PIXELS}),
grown AS (SELECT scene_id, row, col, value, f FROM px UNION SELECT p.scene_id, p.row, p.col, p.value, g.f FROM grown g JOIN px p ON p.scene_id = g.scene_id AND p.value = g.value AND abs(p.row - g.row) + abs(p.col - g.col) = 1 AND g.f < p.f),
named AS MATERIALIZED (SELECT scene_id, row, col, value, CAST(min(f) AS BIGINT) AS region FROM grown GROUP BY ALL)"""
# corners of the grid by how many cells of the region meet there; holes by the Euler number of cells that touch at sides
_MEETS = """meets AS (SELECT scene_id, region, row + dr AS y, col + dc AS x, count(*) AS m, max(row) - min(row) AS h, max(col) - min(col) AS w FROM named, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dr, dc) GROUP BY ALL),
bends AS (SELECT scene_id, region, CAST(sum(CASE WHEN m IN (1, 3) THEN 1 WHEN m = 2 AND h = 1 AND w = 1 THEN 2 ELSE 0 END) AS BIGINT) AS corners, CAST(sum(CASE WHEN m = 1 THEN 1 WHEN m = 3 THEN -1 WHEN m = 2 AND h = 1 AND w = 1 THEN 2 ELSE 0 END) AS BIGINT) AS euler4 FROM meets GROUP BY ALL),
sides AS (SELECT scene_id, region, count(*) AS n FROM (SELECT a.scene_id, a.region FROM named a JOIN named b ON b.scene_id = a.scene_id AND b.region = a.region AND abs(b.row - a.row) + abs(b.col - a.col) = 1) GROUP BY ALL)"""

_SQL = f"""WITH {_REGIONS}, {_MEETS}
SELECT n.scene_id, n.region, n.value, n.area, 4 * n.area - coalesce(s.n, 0) AS perimeter, b.corners, 2 - b.euler4 // 4 AS rings
FROM (SELECT scene_id, region, value, count(*) AS area FROM named GROUP BY ALL) n JOIN bends b ON b.scene_id = n.scene_id AND b.region = n.region LEFT JOIN sides s ON s.scene_id = n.scene_id AND s.region = n.region"""

_coarse = lambda s, d: t.rasters(s, d).withColumn("v", F.col("v") * 8)


@add("region_outlines", _SQL)
def region_outlines(s, d):
    rings = ol.measures(ol.outlines(hy._kept(hy.regions(_coarse(s, d))), shift=2))  # tiles of 4 x 4 cells, so that rings cross them
    return rings.groupBy("scene_id", "region", "value").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.sum("corners").alias("corners"), F.count("*").alias("rings"))


add("region_polygons", f"WITH {_REGIONS} SELECT scene_id, region, value, count(*) * 900.0 AS area FROM named GROUP BY ALL HAVING count(*) >= 4")(
    lambda s, d: ol.vectorized(_coarse(s, d), transform=(30.0, 0.0, 0.0, 0.0, -30.0, 0.0), least_area=3600.0).filter(F.get_json_object("geometry", "$.type") == "Polygon").drop("geometry")
)
