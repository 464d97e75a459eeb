"""Registered queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as geo
from ..functions import indices as ix
from ..functions import radiometry as rd
from ..operators import catalog, detect, network, raster
from ..sources import tables as t
from ..streaming import monitor
from .base import AS_OF, BANDS, DATES, KEY, PAIRS, PIXELS, POINTS, QUERIES, SCENES, SQL, Query, add, bands_query, box, edged, pixel_query, r6, sr

PIX = f"SELECT * FROM {PIXELS}"


def _clip_sql(a: str, b: str) -> str:
    return f"greatest(-1.0, least(1.0, ({a}) / nullif({b}, 0)))"


for _n in ix.CLIPPED:
    bands_query(f"idx_{_n}_eps_clip", lambda n=_n: {n: ix.clipped(n)}, {_n: _clip_sql(*ix.CLIPPED[_n])})
for _n in ix.RATIOS:
    bands_query(f"idx_{_n}_ratio", lambda n=_n: {n: ix.clipped(n)}, {_n: "({}) / nullif({}, 0)".format(*ix.RATIOS[_n])})
for _n in ix.GUARDED:
    bands_query(f"idx_{_n}_guarded", lambda n=_n: {n: ix.guarded(n)}, {_n: "({}) / nullif({}, 0)".format(*ix.GUARDED[_n])})
for _n in ix.TASSELED:
    bands_query(f"tct_{_n}", lambda n=_n: ix.tasseled_cap(n), {k: " + ".join(f"{c} * {b}" for c, b in zip(w, ix.BANDS)) for k, w in ix.TASSELED[_n].items()})
for _n, (_w, _c) in ix.ALBEDO.items():
    bands_query(f"albedo_{_n}", lambda n=_n: {"albedo": ix.albedo(n)}, {"albedo": f"greatest(0.0, least(1.0, {' + '.join(f'{c} * {b}' for c, b in zip(_w, ix.BANDS))} + {_c}))"})
bands_query("lst", lambda: {"lst": rd.land_surface_temperature(F.col("dn"))}, {"lst": "(1321.0789 / ln(774.8853 / (dn * 3.342e-4 + 0.1) + 1)) / (1 + 10.8e-6 * (1321.0789 / ln(774.8853 / (dn * 3.342e-4 + 0.1) + 1)) / 1.438e-2 * ln(0.97))"})
bands_query("landsat_scale", lambda: {"reflectance": rd.landsat_scaled(F.col("dn")) * 1000}, {"reflectance": "CASE WHEN dn <> 0 THEN dn * 2.75e-5 - 0.2 END * 1000"})
bands_query("sar_calibrate_db", lambda: {"db": geo.to_db(F.col("dn") * F.col("dn") / 1e6)}, {"db": "CASE WHEN dn > 0 THEN 10 * log10(dn * dn / 1e6) END"})
bands_query("los_to_vertical", lambda: {"vertical": geo.los_to_vertical(geo.phase_to_displacement(F.col("swir1")), 20 + F.col("green") * 25)}, {"vertical": "swir1 * 0.05546576 / (4 * pi()) / cos(radians(20 + green * 25))"})
bands_query("ionosphere_phase", lambda: {"phase": geo.ionosphere_phase(F.col("green") * 40, 20 + F.col("swir1") * 20)}, {"phase": "4 * pi() * 40.3 * (green * 40) * 1e16 / (sin(acos(6371.0 / (6371.0 + 450.0) * cos(radians(90 - (20 + swir1 * 20))))) * 299792458.0 * (299792458.0 / 0.05546576))"})
bands_query("enu_north_zero", lambda: {"east": F.expr("red / sin(radians(-12.0))"), "up": F.expr("(-nir - red / sin(radians(-12.0)) * sin(radians(35.0)) * cos(radians(-12.0))) / cos(radians(35.0))")}, {"east": "red / sin(radians(-12.0))", "up": "(-nir - red / sin(radians(-12.0)) * sin(radians(35.0)) * cos(radians(-12.0))) / cos(radians(35.0))"})
bands_query("band_math_expr", lambda: {"x": F.expr("(nir - red) * 2 + sqrt(green)")}, {"x": "(nir - red) * 2 + sqrt(green)"})
bands_query("uq_sigma_ndvi", lambda: {"sigma": F.try_divide(F.lit(2.0) * F.sqrt(F.expr("nir * nir * 0.0001 + red * red * 0.0001")), F.expr("(nir + red) * (nir + red)"))}, {"sigma": "2.0 * sqrt(nir * nir * 0.0001 + red * red * 0.0001) / nullif((nir + red) * (nir + red), 0)"})



add("haversine", f"SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(48.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin(radians(2.0 - lon) / 2), 2)))), 6) AS km FROM {POINTS}")(lambda s, d: t.points(s, d).select("c_custkey", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)), 6).alias("km")))
_e2 = repr(1 - (geo.WGS84_B / geo.WGS84_A) ** 2)
_N = f"(6378137.0 / sqrt(1 - {_e2} * pow(sin(radians(lat)), 2)))"
add("geodetic_to_ecef", f"SELECT c_custkey, round(({_N} + c_acctbal) * cos(radians(lat)) * cos(radians(lon)), 3) + 0.0 AS x, round(({_N} + c_acctbal) * cos(radians(lat)) * sin(radians(lon)), 3) + 0.0 AS y, round(({_N} * (1 - {_e2}) + c_acctbal) * sin(radians(lat)), 3) + 0.0 AS z FROM {POINTS}")(lambda s, d: t.points(s, d).select("c_custkey", *[(F.round(v, 3) + F.lit(0.0)).alias(k) for k, v in geo.ecef(F.col("lat"), F.col("lon"), F.col("c_acctbal")).items()]))
add("tile_id", f"SELECT c_custkey, (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(CAST(abs(floor(lat)) AS INT) AS VARCHAR), 3, '0') || (CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(CAST(abs(floor(lon)) AS INT) AS VARCHAR), 3, '0') AS tile FROM {POINTS}")(lambda s, d: t.points(s, d).select("c_custkey", geo.tile_id(F.col("lat"), F.col("lon")).alias("tile")))

# catalog
_SCORE = f"least(1.0, (0.5 * 0.6 + 0.4 * (100 - cloud_cover) / 100) + 0.3 * greatest(0.0, 1 - greatest(0, date_diff('day', CAST(datetime AS DATE), DATE '{AS_OF}')) / 365.0) + CASE WHEN processing_level IN ('L2','L2A','L2SP','ARD') THEN 0.1 ELSE 0.0 END)"
_QUERY = catalog.SceneQuery(bbox=(-90.0, -60.0, 120.0, 70.0), start="2024-01-05 00:00:00", end="2024-01-28 00:00:00", cloud_max=60.0, limit=20)
_WHERE = "min_lon <= 120 AND max_lon >= -90 AND min_lat <= 70 AND max_lat >= -60 AND datetime >= TIMESTAMP '2024-01-05' AND datetime <= TIMESTAMP '2024-01-28' AND (cloud_cover IS NULL OR cloud_cover <= 60)"


@add("catalog_search_topk", f"SELECT id, provider, datetime, cloud_cover, round(score, 9) AS score FROM (SELECT *, {_SCORE} AS score FROM {SCENES} WHERE {_WHERE}) ORDER BY score DESC, id LIMIT 20")
def catalog_search_topk(s: SparkSession, d: str) -> DataFrame:
    return catalog.search(t.scenes(s, d), _QUERY, AS_OF).select("id", "provider", "datetime", "cloud_cover", F.round("score", 9).alias("score"))


add("catalog_filter", f"SELECT id, provider, cloud_cover FROM {SCENES} WHERE {_WHERE}")(lambda s, d: t.scenes(s, d).filter(_QUERY.predicate()).select("id", "provider", "cloud_cover"))
add("catalog_score", f"SELECT id, round({_SCORE}, 9) AS score FROM {SCENES}")(lambda s, d: t.scenes(s, d).select("id", F.round(catalog.score(AS_OF), 9).alias("score")))
add("catalog_dedup_first_of_day", f"SELECT track, day, id FROM (SELECT track, CAST(datetime AS DATE) AS day, id, row_number() OVER (PARTITION BY track, CAST(datetime AS DATE) ORDER BY datetime, id) AS r FROM {SCENES}) WHERE r = 1")(lambda s, d: catalog.deduplicate(t.scenes(s, d).withColumn("day", F.col("datetime").cast("date")).withColumn("at", F.struct("datetime", "id")), ("track", "day"), ("at",)).select("track", "day", "id"))
add("catalog_preflight_report", f"SELECT provider, count(*) AS n_scenes, count(DISTINCT CAST(datetime AS DATE)) AS n_dates, min(datetime) AS first, max(datetime) AS last, round(avg(cloud_cover), 6) AS mean_cloud, CAST(sum(CASE WHEN cloud_cover <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS n_clear FROM {SCENES} GROUP BY provider")(lambda s, d: catalog.preflight(t.scenes(s, d)))
add("catalog_group_hierarchy", f"SELECT provider, year(datetime) AS y, month(datetime) AS m, count(*) AS n FROM {SCENES} GROUP BY ROLLUP (provider, year(datetime), month(datetime))")(lambda s, d: t.scenes(s, d).rollup("provider", F.year("datetime").alias("y"), F.month("datetime").alias("m")).agg(F.count("*").alias("n")))
add("stac_properties_json", f"SELECT id, CAST(properties->>'$.k' AS BIGINT) AS k FROM {SCENES}")(lambda s, d: t.scenes(s, d).select("id", F.get_json_object("properties", "$.k").cast("long").alias("k")))
add("processing_level_case", f"SELECT id, CASE WHEN upper('x_' || processing_level) LIKE '%L2SP%' THEN 'L2SP' WHEN upper('x_' || processing_level) LIKE '%L2A%' THEN 'L2A' ELSE 'L1C' END AS level FROM {SCENES}")(lambda s, d: t.scenes(s, d).select("id", catalog.level_of(F.concat(F.lit("x_"), F.col("processing_level"))).alias("level")))
add("relative_orbit_calc", "SELECT event_id, (event_id - 73) % 175 + 1 AS relative_orbit FROM events WHERE event_id >= 73")(lambda s, d: t.read(s, d, "events").filter("event_id >= 73").select("event_id", ((F.col("event_id") - 73) % 175 + 1).alias("relative_orbit")))
add("qa_bitmask", "SELECT event_id, (event_id & 8) <> 0 AS cloud, (event_id & 16) <> 0 AS shadow, (event_id & 26) = 0 AS clear FROM events")(lambda s, d: t.read(s, d, "events").select("event_id", rd.has_bits(F.col("event_id"), [3]).alias("cloud"), rd.has_bits(F.col("event_id"), [4]).alias("shadow"), (~rd.has_bits(F.col("event_id"))).alias("clear")))
add("track_selection_largest", f"SELECT provider, track, n FROM (SELECT provider, track, count(*) AS n, row_number() OVER (PARTITION BY provider ORDER BY count(*) DESC, track) AS r FROM {SCENES} GROUP BY provider, track) WHERE r = 1")(lambda s, d: t.scenes(s, d).groupBy("provider", "track").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(W.partitionBy("provider").orderBy(F.desc("n"), "track"))).filter("r = 1").drop("r"))

# rasters
_MOM = box(PIX, "any_value(a.v) AS v, avg(b.v) AS m, greatest(0.0, avg(b.v * b.v) - avg(b.v) * avg(b.v)) AS var", 5)
pixel_query("focal_mean_5", "mean", box(PIX, "avg(b.v) AS mean", 5), lambda p: raster.focal_mean(p, 5))
pixel_query("focal_mean_3", "mean", box(PIX, "avg(b.v) AS mean", 3), lambda p: raster.focal_mean(p, 3))
pixel_query("despeckle_boxcar", "out", f"SELECT *, m AS out FROM ({_MOM})", lambda p: raster.despeckle(p, "boxcar"))
pixel_query("despeckle_lee", "out", f"SELECT *, m + var / (var + m * m / (1 + 1e-10) + 1e-10) * (v - m) AS out FROM ({_MOM})", lambda p: raster.despeckle(p, "lee"))
pixel_query("despeckle_gamma", "out", f"SELECT *, m + greatest(0.0, least(1.0, (var - m * m / (1 + 1e-10)) / (var + m * m / (1 + 1e-10) + 1e-10))) * (v - m) AS out FROM ({_MOM})", lambda p: raster.despeckle(p, "gamma"))


def _shift(d: str) -> str:
    """The gradient in SQL along one axis."""
    line = "PARTITION BY scene_id, row ORDER BY col" if d == "x" else "PARTITION BY scene_id, col ORDER BY row"
    return f"CASE WHEN lag(v) OVER ({line}) IS NULL THEN lead(v) OVER ({line}) - v WHEN lead(v) OVER ({line}) IS NULL THEN v - lag(v) OVER ({line}) ELSE (lead(v) OVER ({line}) - lag(v) OVER ({line})) / 2 END AS z{d}"


_GRAD = f"SELECT *, {_shift('x')}, {_shift('y')} FROM {PIXELS}"
pixel_query("gradient", "zx zy", _GRAD, raster.gradient)
pixel_query("slope_aspect_hillshade", "slope hillshade", f"SELECT *, degrees(atan(sqrt(zx * zx + zy * zy))) AS slope, greatest(0.0, least(1.0, cos(radians(45)) * cos(atan(sqrt(zx * zx + zy * zy))) + sin(radians(45)) * sin(atan(sqrt(zx * zx + zy * zy))) * cos(radians(315) - atan2(-zx, zy)))) AS hillshade FROM ({_GRAD})", raster.terrain)
pixel_query("terrain_ruggedness", "tri", box(PIX, "sqrt(sum((b.v - a.v) * (b.v - a.v))) AS tri", 3, edged), raster.ruggedness)
_g2 = lambda v, o, d: _shift(d).replace("(v)", f"({v})").replace("- v ", f"- {v} ").replace("THEN v ", f"THEN {v} ").replace(f"AS z{d}", f"AS {o}")
pixel_query("curvature", "curvature", f"SELECT *, zxx + zyy AS curvature FROM (SELECT scene_id, row, col, {_g2('zx', 'zxx', 'x')}, {_g2('zy', 'zyy', 'y')} FROM ({_GRAD}))", raster.curvature)
pixel_query("multilook_2x2", "v n", f"SELECT scene_id, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, avg(v) AS v, count(v) AS n FROM {PIXELS} GROUP BY ALL", raster.multilook)
for _h, _a in {"mean": "avg(v)", "median": "median(v)", "min": "min(v)", "max": "max(v)", "first": "arg_min(v, scene_id)", "last": "arg_max(v, scene_id)", "sum": "sum(v)"}.items():
    add(f"{'mosaic' if _h in ('first', 'last', 'sum') else 'composite'}_{_h}", f"SELECT row, col, {sr(_a)} AS v FROM {PIXELS} GROUP BY row, col")(lambda s, d, h=_h: raster.composite(t.rasters(s, d), ["row", "col"], h).withColumn("v", r6(F.col("v"))))
_ZONES = f"(SELECT (row // 4) * 2 + col // 4 AS zone, v FROM {PIXELS})"
_zoned = lambda s, d: t.rasters(s, d).withColumn("zone", (F.floor(F.col("row") / 4) * 2 + F.floor(F.col("col") / 4)).cast("int"))
_STATS = {"mean": "avg(v)", "median": "median(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_pop(v)", "sum": "sum(v)", "p90": "quantile_cont(v, 0.9)"}
add("zonal_stats", f"SELECT CAST(zone AS INT) AS zone, count(v) AS count, {', '.join(f'{sr(a)} AS {k}' for k, a in _STATS.items())} FROM {_ZONES} GROUP BY zone")(lambda s, d: raster.zonal_stats(_zoned(s, d), "zone").select("zone", "count", *[r6(F.col(k)).alias(k) for k in _STATS]))
add("class_histogram", f"SELECT CAST(floor(v * 4) AS INT) AS class, count(*) AS n FROM {PIXELS} GROUP BY 1")(lambda s, d: t.rasters(s, d).groupBy(F.floor(F.col("v") * 4).cast("int").alias("class")).agg(F.count("*").alias("n")))
add("dem_of_difference", f"SELECT scene_id, {sr('sum(CASE WHEN b - a > 0.1 THEN (b - a) * 100 ELSE 0 END)')} AS deposition, {sr('-sum(CASE WHEN b - a < -0.1 THEN (b - a) * 100 ELSE 0 END)')} AS erosion FROM {PAIRS} GROUP BY scene_id")(lambda s, d: t.raster_pairs(s, d).withColumn("z", F.col("b") - F.col("a")).groupBy("scene_id").agg(r6(F.sum(F.when(F.col("z") > 0.1, F.col("z") * 100).otherwise(0.0))).alias("deposition"), r6(-F.sum(F.when(F.col("z") < -0.1, F.col("z") * 100).otherwise(0.0))).alias("erosion")))
add("change_detection_log_ratio", f"SELECT scene_id, row, col, {sr('ln((abs(b) + 0.01) / (abs(a) + 0.01))')} AS lr, abs(ln((abs(b) + 0.01) / (abs(a) + 0.01))) > 1.0 AS changed FROM {PAIRS}")(lambda s, d: t.raster_pairs(s, d).withColumn("x", F.log((F.abs("b") + 0.01) / (F.abs("a") + 0.01))).select("scene_id", "row", "col", r6(F.col("x")).alias("lr"), (F.abs("x") > 1.0).alias("changed")))
add("flood_fusion_cloud_aware", f"SELECT scene_id, row, col, CASE WHEN abs(a) < 1.5 THEN a > 0.2 ELSE b < -0.2 END AS flood FROM {PAIRS}")(lambda s, d: t.raster_pairs(s, d).select("scene_id", "row", "col", F.when(F.abs("a") < 1.5, F.col("a") > 0.2).otherwise(F.col("b") < -0.2).alias("flood")))
add("cloud_fill", f"SELECT scene_id, row, col, {sr('CASE WHEN abs(a) > 1 THEN b ELSE a END')} AS v FROM {PAIRS}")(lambda s, d: t.raster_pairs(s, d).select("scene_id", "row", "col", r6(F.when(F.abs("a") > 1, F.col("b")).otherwise(F.col("a"))).alias("v")))
add("adi_ps_select", f"SELECT row, col, {sr('stddev_pop(abs(v)) / avg(abs(v))')} AS adi FROM {PIXELS} GROUP BY row, col")(lambda s, d: t.rasters(s, d).groupBy("row", "col").agg(r6(F.try_divide(F.stddev_pop(F.abs("v")), F.avg(F.abs("v")))).alias("adi")))
add("temporal_coherence", f"SELECT row, col, {sr('sqrt(pow(avg(cos(v)), 2) + pow(avg(sin(v)), 2))')} AS gamma FROM {PIXELS} GROUP BY row, col")(lambda s, d: t.rasters(s, d).groupBy("row", "col").agg(r6(F.sqrt(F.pow(F.avg(F.cos("v")), 2) + F.pow(F.avg(F.sin("v")), 2))).alias("gamma")))
add("risk_index", f"SELECT scene_id, row, col, {sr('0.6 * greatest(least(1.0, abs(v) / 0.5), least(1.0, abs(zx) / 0.3), least(1.0, abs(zy) / 0.3)) + 0.4 * (least(1.0, abs(v) / 0.5) + least(1.0, abs(zx) / 0.3) + least(1.0, abs(zy) / 0.3)) / 3')} AS risk FROM ({_GRAD})")(lambda s, d: raster.gradient(t.rasters(s, d)).withColumn("f", F.array(*[F.least(F.lit(1.0), F.abs(c) / k) for c, k in (("v", 0.5), ("zx", 0.3), ("zy", 0.3))])).select("scene_id", "row", "col", r6(0.6 * F.array_max("f") + 0.4 * F.aggregate("f", F.lit(0.0), lambda a, x: a + x) / 3).alias("risk")))

# detectors and measures
_RING = box(PIX, "any_value(a.v) AS v, avg(CASE WHEN abs(dr) > 1 OR abs(dc) > 1 THEN b.v END) AS m, stddev_pop(CASE WHEN abs(dr) > 1 OR abs(dc) > 1 THEN b.v END) AS s", 7)
add("cfar_targets", f"SELECT {KEY}, {sr('m')} AS ring_mean, {sr('s')} AS ring_std, v > m + 2.0 * s AS target FROM ({_RING})")(lambda s, d: detect.bright_targets(t.rasters(s, d), 3, 7, 2.0).select("scene_id", "row", "col", r6(F.col("ring_mean")).alias("ring_mean"), r6(F.col("ring_std")).alias("ring_std"), "target"))
_LEVEL = f"SELECT scene_id, row, col, q, q - coalesce(lag(q) OVER (PARTITION BY scene_id, row ORDER BY col), last_value(q) OVER (PARTITION BY scene_id, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS d FROM (SELECT *, floor(63 * coalesce((v - min(v) OVER (PARTITION BY scene_id)) / nullif(max(v) OVER (PARTITION BY scene_id) - min(v) OVER (PARTITION BY scene_id), 0), 0)) AS q FROM {PIXELS})"
pixel_query("texture", "contrast dissimilarity homogeneity asm", box(_LEVEL, "avg(b.d * b.d) AS contrast, avg(abs(b.d)) AS dissimilarity, avg(1 / (1 + b.d * b.d)) AS homogeneity, 1 / (1 + greatest(0.0, avg(b.q * b.q) - avg(b.q) * avg(b.q))) AS asm", 5), detect.texture)
pixel_query("despeckle_enhanced_lee", "out", f"SELECT *, (1 - w) * m + w * v AS out FROM (SELECT *, CASE WHEN cv <= t THEN 0.0 WHEN cv > 3 * t THEN 1.0 ELSE (cv - t) / (2 * t + 1e-10) END AS w FROM (SELECT *, sqrt(var) / (m + 1e-10) AS cv, 1 / sqrt(1 + 1e-10) AS t FROM ({_MOM})))", lambda p: raster.despeckle(p, "enhanced_lee"))
_D8 = "(VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) AS o(i, dr, dc)"
add("d8_direction", f"SELECT {KEY}, CAST(CASE WHEN max(z) > 0 THEN arg_min(i, (-z, i)) ELSE -1 END AS INT) AS direction FROM (SELECT a.scene_id, a.row, a.col, o.i, (a.v - b.v) / sqrt(o.dr * o.dr + o.dc * o.dc) AS z FROM {PIXELS} a, {_D8}, {PIXELS} b WHERE b.scene_id = a.scene_id AND b.row = a.row + o.dr AND b.col = a.col + o.dc) GROUP BY {KEY}")(lambda s, d: detect.flow_direction(t.rasters(s, d)))
pixel_query("dos1", "out", f"SELECT p.*, CASE WHEN v > 0 THEN v - dark ELSE 0 END AS out FROM {PIXELS} p LEFT JOIN (SELECT scene_id, quantile_cont(v, 0.01) AS dark FROM {PIXELS} WHERE v > 0 GROUP BY scene_id) USING (scene_id)", detect.subtract_dark)
pixel_query("despike_median", "out", f"SELECT a.scene_id, a.row, a.col, median(b.v) AS out FROM {PIXELS} a, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc), {PIXELS} b WHERE b.scene_id = a.scene_id AND b.row = greatest(0, least(7, a.row + dr)) AND b.col = greatest(0, least(7, a.col + dc)) GROUP BY a.scene_id, a.row, a.col", detect.median_3x3)
_COH = box(f"SELECT * FROM {PAIRS}", "sqrt(pow(sum(cos(b.a - b.b)), 2) + pow(sum(sin(b.a - b.b)), 2)) / count(*) AS coherence", 5)
add("coherence_window", f"SELECT {KEY}, {sr('coherence')} AS coherence FROM ({_COH})")(lambda s, d: detect.coherence(t.raster_pairs(s, d).select("scene_id", "row", "col", F.cos("a").alias("re1"), F.sin("a").alias("im1"), F.cos("b").alias("re2"), F.sin("b").alias("im2"))).withColumn("coherence", r6(F.col("coherence"))))
_mid = lambda c, part, by: f"(lead({c}) OVER (PARTITION BY scene_id, {part} ORDER BY {by}) - lag({c}) OVER (PARTITION BY scene_id, {part} ORDER BY {by})) / 2"
add("strain_tensor", f"SELECT {KEY}, {sr(_mid('a', 'row', 'col'))} AS exx, {sr(_mid('b', 'col', 'row'))} AS eyy, {sr('(' + _mid('a', 'col', 'row') + ' + ' + _mid('b', 'row', 'col') + ') / 2')} AS exy FROM {PAIRS}")(lambda s, d: detect.strain(t.raster_pairs(s, d).withColumnsRenamed({"a": "dx", "b": "dy"})).select("scene_id", "row", "col", *[r6(F.col(c)).alias(c) for c in ("exx", "eyy", "exy")]))
add("structure_function", " UNION ALL ".join(f"SELECT {n} AS lag, {sr('sqrt(avg(d * d))')} AS rms, count(d) AS n FROM (SELECT v - lag(v, {n}) OVER (PARTITION BY scene_id, row ORDER BY col) AS d FROM {PIXELS})" for n in (1, 2, 4)))(lambda s, d: detect.structure_function(t.rasters(s, d)).withColumn("rms", r6(F.col("rms"))))
for _h, _op in {"union": "OR", "intersection": "AND"}.items():
    add(f"flood_fusion_{_h}", f"SELECT scene_id, row, col, CASE WHEN abs(a) < 1.5 THEN (a > 0.2) {_op} (b < -0.2) ELSE b < -0.2 END AS flood FROM {PAIRS}")(lambda s, d, op=_op: t.raster_pairs(s, d).select("scene_id", "row", "col", F.expr(f"CASE WHEN abs(a) < 1.5 THEN (a > 0.2) {op} (b < -0.2) ELSE b < -0.2 END").alias("flood")))
add("kmeans_pixels", None)(lambda s, d: detect.kmeans(t.bands(s, d).select("l_orderkey", "l_linenumber", "green", "red", "nir"), ["green", "red", "nir"]))

# time series of parts
_T = "date_diff('day', DATE '1970-01-01', date) / 365.25"
add("pixel_trend", f"SELECT l_partkey, {sr(f'regr_slope(dn, {_T})')} AS slope, count(dn) AS n FROM {BANDS} GROUP BY l_partkey HAVING count(DISTINCT date) >= 2")(lambda s, d: raster.trend(t.bands(s, d), ["l_partkey"], value="dn").filter("slope IS NOT NULL").withColumn("slope", r6(F.col("slope"))))
add("pixel_anomaly", f"SELECT l_partkey, {sr('(avg(CASE WHEN year(date) >= 2000 THEN dn END) - avg(CASE WHEN year(date) < 2000 THEN dn END)) / nullif(stddev_pop(CASE WHEN year(date) < 2000 THEN dn END), 0)')} AS z FROM {BANDS} GROUP BY l_partkey")(lambda s, d: raster.anomaly(t.bands(s, d), ["l_partkey"], F.year("date") < 2000, F.year("date") >= 2000, "dn").withColumn("z", r6(F.col("z"))))
add("zonal_timeseries", f"SELECT CAST(l_partkey % 25 AS BIGINT) AS zone, year(date) AS y, {sr('avg(dn)')} AS mean FROM {BANDS} GROUP BY ALL")(lambda s, d: t.bands(s, d).groupBy((F.col("l_partkey") % 25).alias("zone"), F.year("date").alias("y")).agg(r6(F.avg("dn")).alias("mean")))
add("height_slope_regr", f"SELECT l_partkey % 50 AS grp, {sr('regr_slope(dn, green)')} AS slope, {sr('corr(dn, green)')} AS r FROM {BANDS} GROUP BY 1")(lambda s, d: t.bands(s, d).groupBy((F.col("l_partkey") % 50).alias("grp")).agg(r6(F.regr_slope("dn", "green")).alias("slope"), r6(F.corr("dn", "green")).alias("r")))

# networks and joins
add("candidate_pairs_range", f"SELECT a.track, a.date AS d1, b.date AS d2, CAST(date_diff('day', a.date, b.date) AS INT) AS days FROM {DATES} a JOIN {DATES} b ON a.track = b.track AND b.date > a.date AND date_diff('day', a.date, b.date) <= 5")(lambda s, d: network.candidate_pairs(t.track_dates(s, d), "track", 5))
add("incremental_knn_pairs", f"SELECT a.track, a.date AS d1, b.date AS d2, CAST(b.i - a.i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY date) AS i FROM {DATES}) a JOIN (SELECT *, row_number() OVER (PARTITION BY track ORDER BY date) AS i FROM {DATES}) b ON a.track = b.track AND b.i - a.i BETWEEN 1 AND 3")(lambda s, d: network.nearest_pairs(t.track_dates(s, d), "track", 3))
_GAP = f"(SELECT *, date_diff('day', lag(date) OVER (PARTITION BY track ORDER BY date), date) AS gap FROM {DATES})"
add("max_gap_per_track", f"SELECT track, count(*) AS n_dates, CAST(max(gap) AS INT) AS max_gap FROM {_GAP} GROUP BY track")(lambda s, d: network.gaps(t.track_dates(s, d), "track"))
add("components_per_track", f"SELECT track, island, count(*) AS n_dates, min(date) AS first, max(date) AS last FROM (SELECT track, date, CAST(sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY date) AS BIGINT) AS island FROM {_GAP}) GROUP BY track, island")(lambda s, d: network.islands(t.track_dates(s, d), "track", 2))
add("asof_burst_sync", "SELECT o_orderkey, o_custkey, value FROM (SELECT o_orderkey, o_custkey, o_orderdate AS ts FROM orders) o ASOF LEFT JOIN (SELECT l_orderkey % 1500 AS o_custkey, l_shipdate AS ts, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL) l USING (o_custkey, ts)")(lambda s, d: network.asof(t.read(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("ts")), t.read(s, d, "lineitem").groupBy((F.col("l_orderkey") % 1500).alias("o_custkey"), F.col("l_shipdate").alias("ts")).agg(F.max("l_extendedprice").alias("value")), "o_custkey", "ts", "value").select("o_orderkey", "o_custkey", "value"))
_ZBOX = "(SELECT n_nationkey, CAST(n_nationkey * 14 - 180 AS DOUBLE) AS x0, CAST(n_nationkey * 14 - 150 AS DOUBLE) AS x1 FROM nation)"
_zbox = lambda s, d: t.read(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 14 - 180).cast("double").alias("x0"), (F.col("n_nationkey") * 14 - 150).cast("double").alias("x1"))


def _zone_cells(s: SparkSession, d: str) -> DataFrame:
    """Zones by the 10-degree cells that they touch, so that the join with points is on equal cells."""
    z = _zbox(s, d)
    return z.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / 10), F.floor(F.col("x1") / 10))))


@add("zone_point_join", f"SELECT n_nationkey, count(*) AS n, {sr('sum(c_acctbal)')} AS total FROM {_ZBOX} z JOIN {POINTS} p ON lon >= x0 AND lon < x1 GROUP BY n_nationkey")
def zone_point_join(s: SparkSession, d: str) -> DataFrame:
    p = t.points(s, d).withColumn("cell", F.floor(F.col("lon") / 10))
    return p.join(_zone_cells(s, d), "cell").filter("lon >= x0 AND lon < x1").groupBy("n_nationkey").agg(F.count("*").alias("n"), r6(F.sum("c_acctbal")).alias("total"))


@add("zone_point_join_left", f"SELECT c_custkey, count(n_nationkey) AS zones FROM {POINTS} p LEFT JOIN {_ZBOX} z ON lon >= x0 AND lon < x1 GROUP BY c_custkey")
def zone_point_join_left(s: SparkSession, d: str) -> DataFrame:
    p = t.points(s, d).withColumn("cell", F.floor(F.col("lon") / 10))
    z = _zone_cells(s, d).withColumnRenamed("cell", "zc")
    return p.join(z, (F.col("cell") == F.col("zc")) & (F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1")), "left").groupBy("c_custkey").agg(F.count("n_nationkey").alias("zones"))


add("dissolve_sum", "SELECT p_brand, p_type, count(*) AS n, round(sum(p_retailprice), 4) AS total, CAST(min(p_size) AS INT) AS min_size, CAST(max(p_size) AS INT) AS max_size FROM part GROUP BY p_brand, p_type")(lambda s, d: t.read(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"), F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size")))
add("monitor_anti_join", f"SELECT track, date FROM {DATES} WHERE date >= DATE '2024-01-20' EXCEPT SELECT track, date FROM {DATES} WHERE date < DATE '2024-01-25'")(lambda s, d: monitor.new_rows(t.track_dates(s, d).filter("date >= '2024-01-20'"), t.track_dates(s, d).filter("date < '2024-01-25'"), ["track", "date"]))
add("arrivals_daily", f"SELECT date_trunc('day', datetime) AS day, provider, count(*) AS n, {sr('avg(cloud_cover)')} AS cloud FROM {SCENES} GROUP BY ALL")(lambda s, d: monitor.arrivals(t.scenes(s, d)).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "provider", "n", r6(F.col("cloud")).alias("cloud")))


@add("catalog_monitor_stream", f"SELECT track, date FROM {DATES}")
def catalog_monitor_stream(s: SparkSession, d: str) -> DataFrame:
    """Reads the events as a stream of files, twice; the state table is the result."""
    at = monitor.fresh_folder(s, "monitor")
    for _ in range(2):  # the second run finds nothing new
        monitor.run_available(s, d, t.read(s, d, "events").schema, f"{at}/state", f"{at}/checkpoint", ["track", "date"], "events.parquet", lambda e: e.select(F.col("user_id").alias("track"), F.col("ts").cast("date").alias("date")))
    return monitor.processed(s, f"{at}/state")


from . import coregister, esd, geodesy, geolocation, grids, hydrology, ionosphere, networks, outlines, phases, products, radiometry, ramps, scenes, series, unwrap, vectors  # noqa: E402, F401  they register theirs


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(SQL)
