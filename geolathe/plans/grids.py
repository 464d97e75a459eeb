"""Queries of grids and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, grids, network, raster
from ..operators import vectors as ve
from ..sources import tables as t
from .base import KEY, PAIRS, PIXELS, add, box, pixel_query, r6, sr

_c = F.col
_of = lambda s, d, i: t.rasters(s, d).filter(f"scene_id % 3 = {i}").withColumn("g", F.floor(_c("scene_id") / 3))
_S = lambda i: f"(SELECT scene_id // 3 AS g, row, col, v FROM {PIXELS} WHERE scene_id % 3 = {i})"
add("band_stack", f"SELECT g, row, col, {sr('x.v')} AS b0, {sr('y.v')} AS b1, {sr('z.v')} AS b2 FROM {_S(0)} x LEFT JOIN {_S(1)} y USING (g, row, col) LEFT JOIN {_S(2)} z USING (g, row, col)")(
    lambda s, d: grids.stacked({f"b{i}": _of(s, d, i) for i in range(3)}, ["g", "row", "col"]).select("g", "row", "col", *[r6(_c(f"b{i}")).alias(f"b{i}") for i in range(3)])
)
add("time_stack", f"SELECT date, count(*) AS n, {sr('sum(v)')} AS total FROM (SELECT DATE '2024-01-01' AS date, v FROM {_S(0)} UNION ALL SELECT DATE '2024-02-01', v FROM {_S(1)}) GROUP BY date")(
    lambda s, d: grids.in_time({"2024-02-01": _of(s, d, 1), "2024-01-01": _of(s, d, 0)}, ["g", "row", "col"]).groupBy("date").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))
)
add("clip_window", f"SELECT {KEY}, {sr('v')} AS v FROM {PIXELS} WHERE row >= 2 AND row < 6 AND col >= 1 AND col < 4")(lambda s, d: grids.clipped(t.rasters(s, d), (2, 6), (1, 4)).withColumn("v", r6(_c("v"))))
add("clip_polygon", f"SELECT {KEY}, {sr('CASE WHEN (row + 0.5) + (col + 0.5) < 7.7 THEN v ELSE 0 END')} AS v FROM {PIXELS}")(
    lambda s, d: grids.clipped(t.rasters(s, d), ring=ve.ring((F.lit(0), F.lit(0)), (F.lit(7.7), F.lit(0)), (F.lit(0), F.lit(7.7))), outside=0.0).withColumn("v", r6(_c("v")))
)
add("raster_tiles", f"SELECT scene_id, tile_row, tile_col, count(*) AS n FROM {PIXELS}, (SELECT unnest(range(0, 3)) AS tile_row), (SELECT unnest(range(0, 3)) AS tile_col) WHERE row >= tile_row * 3 AND row < tile_row * 3 + 4 AND col >= tile_col * 3 AND col < tile_col * 3 + 4 GROUP BY ALL")(
    lambda s, d: grids.tiles(t.rasters(s, d), 4, 1).groupBy("scene_id", "tile_row", "tile_col").agg(F.count("*").alias("n"))
)
_g = lambda p, o: f"CASE WHEN lag(v) OVER (PARTITION BY scene_id, {p} ORDER BY {o}) IS NULL THEN lead(v) OVER (PARTITION BY scene_id, {p} ORDER BY {o}) - v WHEN lead(v) OVER (PARTITION BY scene_id, {p} ORDER BY {o}) IS NULL THEN v - lag(v) OVER (PARTITION BY scene_id, {p} ORDER BY {o}) ELSE (lead(v) OVER (PARTITION BY scene_id, {p} ORDER BY {o}) - lag(v) OVER (PARTITION BY scene_id, {p} ORDER BY {o})) / 2 END"
_TER = f"(SELECT scene_id, row, col, degrees(atan(sqrt(zx * zx + zy * zy))) AS slope, degrees(atan2(-zx, zy)) AS aspect FROM (SELECT *, {_g('row', 'col')} AS zx, {_g('col', 'row')} AS zy FROM {PIXELS}))"
pixel_query("local_incidence", "angle", f"SELECT *, 35.0 + slope * cos(radians(aspect - 78.0)) AS angle FROM {_TER}", lambda p: raster.terrain(p).withColumn("angle", grids.local_incidence(_c("slope"), _c("aspect"), F.lit(35.0), F.lit(-12.0))))
add("insar_mask", f"SELECT {KEY}, 35.0 + slope * cos(radians(aspect - 78.0)) > 0 AND 35.0 + slope * cos(radians(aspect - 78.0)) < 90 AS ok FROM {_TER}")(lambda s, d: raster.terrain(t.rasters(s, d)).select("scene_id", "row", "col", grids.visible(_c("slope"), _c("aspect"), F.lit(35.0), F.lit(-12.0)).alias("ok")))
_W = "OVER (PARTITION BY scene_id, row ORDER BY col)"
_RISE = f"degrees(atan((coalesce(lead(v) {_W}, v) - coalesce(lag(v) {_W}, v)) / (0.8 * (coalesce(lead(col) {_W}, col) - coalesce(lag(col) {_W}, col)))))"
add("layover_shadow_rows", f"SELECT {KEY}, {_RISE} < 39 AND {_RISE} > -51 AS ok FROM {PIXELS}")(lambda s, d: grids.range_slope_mask(t.rasters(s, d), 39.0, 0.8).select("scene_id", "row", "col", "ok"))
_M = f"(SELECT scene_id, row, col, sqrt(a * a + b * b) AS m FROM {PAIRS})"
_D2 = lambda p, o: f"abs(lead(m) OVER (PARTITION BY scene_id, {p} ORDER BY {o}) - 2 * m + lag(m) OVER (PARTITION BY scene_id, {p} ORDER BY {o}))"
add("displacement_curvature", f"SELECT {KEY}, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {sr('greatest(a, b)')} END AS curvature FROM (SELECT *, {_D2('row', 'col')} AS a, {_D2('col', 'row')} AS b FROM {_M})")(
    lambda s, d: grids.displacement_curvature(t.raster_pairs(s, d).withColumnsRenamed({"a": "dx", "b": "dy"})).withColumn("curvature", r6(_c("curvature")))
)
_POW = f"SELECT scene_id, row, col, v * v AS v FROM {PIXELS}"
_MOM = box(_POW, "any_value(a.v) AS v, avg(b.v) AS m, greatest(0.0, avg(b.v * b.v) - avg(b.v) * avg(b.v)) AS var", 5)
_DBL = f"(SELECT scene_id, row, col, 10 * log10(greatest(m + var / (var + m * m / (1 + 1e-10) + 1e-10) * (v - m), 1e-10)) AS db FROM ({_MOM}))"
add("grd_preprocessed_flood", f"SELECT {KEY}, {sr('db')} AS db, db < -3 AS flood FROM {_DBL}")(lambda s, d: grids.flood_mapped(t.rasters(s, d), -3.0).withColumn("db", r6(_c("db"))))
_COH = box(f"SELECT * FROM {PAIRS}", "sqrt(pow(sum(cos(b.a - b.b)), 2) + pow(sum(sin(b.a - b.b)), 2)) / count(*) AS c", 5)
add("coherence_disturbance", f"SELECT scene_id, {sr('100.0 * count(CASE WHEN c < 0.3 THEN 1 END) / count(c)')} AS percent FROM ({_COH}) GROUP BY scene_id")(
    lambda s, d: grids.coherence_loss(t.raster_pairs(s, d).select("scene_id", "row", "col", F.cos("a").alias("re1"), F.sin("a").alias("im1"), F.cos("b").alias("re2"), F.sin("b").alias("im2")), 0.3, 5).withColumn("percent", r6(_c("percent")))
)
_B = "(SELECT swath, burst, start, 6 AS lines FROM (SELECT DISTINCT p_partkey % 40 AS swath, p_partkey // 40 AS burst, CAST(p_partkey // 40 * 5 AS DOUBLE) AS start FROM part))"
add("deburst_lines", f"SELECT swath, burst, line, CAST(row_number() OVER (PARTITION BY swath ORDER BY start, line) - 1 AS BIGINT) AS row FROM (SELECT *, lag(start) OVER (PARTITION BY swath ORDER BY start) AS before, lead(start) OVER (PARTITION BY swath ORDER BY start) AS after FROM {_B}), (SELECT unnest(range(0, 6)) AS line) WHERE line >= coalesce(ceil((before + 6 + start) / 2 - start - 1e-9), 0) AND line < coalesce(ceil((after + start + 6) / 2 - start - 1e-9), 6)")(
    lambda s, d: (lambda b: grids.debursted(b.select("swath", "burst", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("line")), network.burst_rows(b, "swath", 1.0), "swath").select("swath", "burst", _c("line").cast("long").alias("line"), "row"))(
        t.read(s, d, "part").select((_c("p_partkey") % 40).alias("swath"), F.floor(_c("p_partkey") / 40).alias("burst"), (F.floor(_c("p_partkey") / 40) * 5).cast("double").alias("start"), F.lit(6).alias("lines")).distinct()
    )
)


@add("offset_polynomial", "SELECT 0 AS px, 0 AS py, 1.5 AS c UNION ALL SELECT 1, 0, 0.25 UNION ALL SELECT 0, 1, -0.75 UNION ALL SELECT 2, 0, 0.1 UNION ALL SELECT 1, 1, 0.0 UNION ALL SELECT 0, 2, 0.3")
def offset_polynomial(s, d):
    """Finds the surface that the offsets of the points were made of, beside some that are far off."""
    p = t.points(s, d).select((_c("lon") / 180).alias("x"), (_c("c_acctbal") / 1e4).alias("y"), "c_custkey")
    p = p.withColumn("o", 1.5 + 0.25 * _c("x") - 0.75 * _c("y") + 0.1 * _c("x") * _c("x") + 0.3 * _c("y") * _c("y") + F.when(_c("c_custkey") % 50 == 0, 9.0).otherwise(0.0))
    found, _ = fits.robust_polynomial(p, "o", 2)
    return s.createDataFrame([(i, j, round(c, 6) + 0.0) for (i, j), c in found.items()], "px int, py int, c double")


@add("forest_classes", None)
def forest_classes(s, d):
    b = t.bands(s, d).select("l_orderkey", "l_linenumber", "green", "red", "nir").withColumn("label", F.when(_c("green") > 0.6, "high").when(_c("red") > _c("nir"), "dry").otherwise("green"))
    model, names, _ = fits.train_forest(b, ["green", "red", "nir"], "label", trees=10)
    return fits.predict_forest(model, names, b.drop("label"), ["green", "red", "nir"])
