"""Queries of geodetic and radar geometry, and of names and boxes as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import names as nm
from ..sources import tables as t
from .base import POINTS, SCENES, add, bands_query, points_query, r6, sr

_c = F.col
_LAT, _LON, _H = (lambda n=n: F.col(n) for n in ("lat", "lon", "c_acctbal"))
_there = lambda: geo.ecef(_LAT(), _LON(), _H())

# there and back: the inverse gives what it was made of
points_query("ecef_to_geodetic", lambda: (lambda p: geo.geodetic(p["x"], p["y"], p["z"]))(_there()), {"lat": "lat", "lon": "CASE WHEN lon = -180 THEN -180.0 ELSE lon END", "height": "c_acctbal"}, 4)
bands_query("range_offset_vertical", lambda: {"vertical": geo.range_offset_to_vertical(_c("red") * 10, 2.33, 30 + _c("green") * 10)}, {"vertical": "-red * 10 * 2.33 / cos(radians(30 + green * 10))"})
bands_query("pixel_offsets_metres", lambda: geo.offsets_in_metres(_c("red") * 10, _c("nir") * 10, 2.33, 13.9), {"range_m": "red * 10 * 2.33", "azimuth_m": "nir * 10 * 13.9"})
bands_query("displacement_to_los", lambda: {"los": geo.line_of_sight(_c("red"), _c("nir"), _c("swir1"), 30 + _c("green") * 10, F.lit(-12.0))}, {"los": "red * sin(radians(30 + green * 10)) * sin(radians(78.0)) + nir * sin(radians(30 + green * 10)) * cos(radians(78.0)) + swir1 * cos(radians(30 + green * 10))"})
_I, _R = "radians(30 + green * 10)", "(red + swir1 * cos(radians(30 + green * 10)))"
bands_query("enu_known_vertical", lambda: geo.east_north(_c("red"), _c("nir"), 30 + _c("green") * 10, F.lit(-12.0), _c("swir1")), {"east": f"(cos(radians(-12.0)) * {_R} - sin({_I}) * sin(radians(-12.0)) * nir) / -sin({_I})", "north": f"(-sin(radians(-12.0)) * {_R} - sin({_I}) * cos(radians(-12.0)) * nir) / -sin({_I})"})
bands_query("enu_no_north", lambda: geo.east_up(_c("nir"), _c("red"), 30 + _c("green") * 10, F.lit(-12.0)), {"east": "red / sin(radians(-12.0))", "up": f"(-nir - red / sin(radians(-12.0)) * sin({_I}) * cos(radians(-12.0))) / cos({_I})"})
bands_query("zenith_delay_phase", lambda: {"phase": geo.delay_phase(_c("swir1"), 30 + _c("green") * 10)}, {"phase": f"4 * pi() / 0.05546576 * swir1 / cos({_I})"})
bands_query("wrap_phase", lambda: {"phase": geo.wrapped(_c("swir1") * 40 - 20)}, {"phase": "(swir1 * 40 - 20 + pi()) - 2 * pi() * floor((swir1 * 40 - 20 + pi()) / (2 * pi())) - pi()"})
bands_query("shell_mapping", lambda: {"m": geo.mapping_function(20 + _c("green") * 20)}, {"m": "1 / sin(acos(6371.0 / 6821.0 * cos(radians(90 - (20 + green * 20)))))"})
bands_query("topographic_phase", lambda: {"phase": geo.topographic_phase(_c("dn") / 1000 - 40)}, {"phase": "4 * pi() / 0.05546576 * abs(dn / 1000 - 40) / (850000.0 * sin(radians(39.0))) * 100"})
_EL, _AZ = "radians(40 + abs(lat) / 4)", "radians(lon)"
_PSI = f"(acos(6371.0 / 6821.0 * cos({_EL})) - {_EL})"
_IL = f"asin(sin(radians(lat)) * cos({_PSI}) + cos(radians(lat)) * sin({_PSI}) * cos({_AZ}))"
points_query("ionosphere_pierce_point", lambda: geo.pierce_point(_LAT(), _LON(), _LON(), 40 + F.abs("lat") / 4), {"ipp_lat": f"degrees({_IL})", "ipp_lon": f"lon + degrees(asin(sin({_PSI}) * sin({_AZ}) / cos({_IL})))"})
_P, _Q, _G = ("lat", "lon", "c_acctbal"), ("lat + 3", "lon - 2", "c_acctbal + 5"), ("lat * 2 + 50", "lon + 30", "1000 - lat")
_B, _L = [f"(({q}) - ({p}))" for p, q in zip(_P, _Q)], [f"(({g}) - ({p}))" for p, g in zip(_P, _G)]
_dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v)) + ")"
points_query("perpendicular_baseline", lambda: {"b": geo.perpendicular_baseline(*(tuple(map(F.expr, x)) for x in (_P, _Q, _G)))}, {"b": f"sqrt(greatest(0.0, {_dot(_B, _B)} - {_dot(_B, _L)} * {_dot(_B, _L)} / nullif({_dot(_L, _L)}, 0)))"})
_D = "(2 * pi() * (c_custkey % 365) / 365)"
_EOT = f"(229.18 * (0.000075 + 0.001868 * cos({_D}) - 0.032077 * sin({_D}) - 0.014615 * cos(2 * {_D}) - 0.040849 * sin(2 * {_D})))"
_DEC = f"(0.006918 - 0.399912 * cos({_D}) + 0.070257 * sin({_D}) - 0.006758 * cos(2 * {_D}) + 0.000907 * sin(2 * {_D}) - 0.002697 * cos(3 * {_D}) + 0.00148 * sin(3 * {_D}))"
_TURN = f"radians((60 * (c_custkey % 24) + {_EOT} + 4 * lon) / 4 - 180)"
_CZ = f"greatest(-1.0, least(1.0, sin(radians(lat)) * sin({_DEC}) + cos(radians(lat)) * cos({_DEC}) * cos({_TURN})))"
_AZI = f"degrees(acos(greatest(-1.0, least(1.0, -(sin(radians(lat)) * {_CZ} - sin({_DEC})) / (cos(radians(lat)) * sin(acos({_CZ})) + 1e-12)))))"
points_query("solar_position", lambda: geo.solar_position(_c("c_custkey") % 24, _c("c_custkey") % 365 + 1, _LAT(), _LON()), {"zenith": f"degrees(acos({_CZ}))", "azimuth": f"CASE WHEN sin({_TURN}) > 0 THEN 360 - {_AZI} ELSE {_AZI} END"}, 4)
points_query("degree_cell_area", lambda: {"m2": geo.degree_cell_area_m2(_LAT(), 0.25, 0.5)}, {"m2": "abs(0.25 * 111320.0 * 0.5 * 111320.0 * cos(radians(lat)))"}, 3)
_HV = lambda a, b, c, d: f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
_BOX = lambda: (_LON(), _LAT(), _LON() + 1.5, _LAT() + 2.25)
points_query("bbox_area", lambda: {"km2": geo.box_area_km2(_BOX())}, {"km2": f"{_HV('lat', 'lon', 'lat', '(lon + 1.5)')} * {_HV('lat', 'lon', '(lat + 2.25)', 'lon')}"}, 4)
add("point_in_bbox", f"SELECT c_custkey, lon >= -20 AND lon <= 30 AND lat >= -10 AND lat <= 60 AS inside FROM {POINTS}")(lambda s, d: t.points(s, d).select("c_custkey", geo.in_box(_LON(), _LAT(), tuple(map(F.lit, (-20, -10, 30, 60)))).alias("inside")))
add("bbox_union", f"SELECT provider, min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat FROM {SCENES} GROUP BY provider")(lambda s, d: t.scenes(s, d).groupBy("provider").agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat")))
add("atmosphere_hour_weights", "SELECT event_id, h.hour AS hour, round(h.weight, 6) AS weight FROM (SELECT event_id, unnest([{'hour': date_trunc('hour', ts), 'weight': 1 - epoch_us(ts - date_trunc('hour', ts)::TIMESTAMP) / 3.6e9}, {'hour': date_trunc('hour', ts) + INTERVAL 1 HOUR, 'weight': epoch_us(ts - date_trunc('hour', ts)::TIMESTAMP) / 3.6e9}]) AS h FROM events)".replace("epoch_us(ts - date_trunc('hour', ts)::TIMESTAMP)", "(epoch_us(ts) - epoch_us(date_trunc('hour', ts)))"))(
    lambda s, d: t.read(s, d, "events").select("event_id", F.explode(geo.hour_weights(_c("ts"))).alias("h")).select("event_id", _c("h.hour").cast("timestamp_ntz").alias("hour"), F.round("h.weight", 6).alias("weight"))
)
_W = {"row0": "floor((80.0 - (lat + 2.25)) / 0.5 + 1e-9)", "row1": "ceil((80.0 - lat) / 0.5 - 1e-9)", "col0": "floor((lon - (-170.0)) / 0.75 + 1e-9)", "col1": "ceil((lon + 1.5 - (-170.0)) / 0.75 - 1e-9)"}
_cut = lambda k: f"greatest(0, least({280 if k[0] == 'r' else 400}, {_W[k]}))"
_COV = f"greatest(0, {_cut('col1')} - {_cut('col0')}) * greatest(0, {_cut('row1')} - {_cut('row0')}) / nullif(({_W['col1']} - {_W['col0']}) * ({_W['row1']} - {_W['row0']}), 0)"
points_query("pixel_window_coverage", lambda: geo.pixel_window(_BOX(), (-170.0, 80.0), (0.75, 0.5), (280, 400)), {**{k: _cut(k) for k in _W}, "coverage": _COV})
points_query("pixel_window_bounds", lambda: geo.window_bounds(_c("c_custkey") % 10, _c("c_custkey") % 10 + 4, _c("c_custkey") % 7, _c("c_custkey") % 7 + 3, (-170.0, 80.0), (0.75, 0.5)), {"min_lon": "-170.0 + (c_custkey % 7) * 0.75", "min_lat": "80.0 - (c_custkey % 10 + 4) * 0.5", "max_lon": "-170.0 + (c_custkey % 7 + 3) * 0.75", "max_lat": "80.0 - (c_custkey % 10) * 0.5"})
_TILE = lambda y, x: f"(CASE WHEN {y} >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(CAST({y} AS INT)) AS VARCHAR), 3, '0') || (CASE WHEN {x} >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(CAST({x} AS INT)) AS VARCHAR), 3, '0')"
add("tiles_covering_bbox", f"SELECT c_custkey, {_TILE('(lat + i)', '(lon + j)')} AS tile FROM {POINTS}, (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 2)) AS j)")(lambda s, d: t.points(s, d).select("c_custkey", F.explode(geo.tiles_covering(_BOX())).alias("tile")))

# text
_TXT = "(CAST(lon AS VARCHAR) || ', ' || CAST(lat AS VARCHAR) || ',' || CAST(lon + 1.5 AS VARCHAR) || ',' || CAST(lat + 2.25 AS VARCHAR))"
_txt = lambda: F.format_string("%s, %s,%s,%s", *[x.cast("string") for x in _BOX()])
add("bbox_parse", f"SELECT c_custkey, lon AS x0, lat AS y0, lon + 1.5 AS x1, lat + 2.25 AS y1, lon >= -180 AND lon + 1.5 <= 180 AND lat + 2.25 <= 90 AS valid FROM {POINTS}")(
    lambda s, d: t.points(s, d).withColumn("b", nm.parse_box(_txt())).select("c_custkey", *[_c("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], nm.valid_box(_txt()).alias("valid"))
)
_P2 = lambda x: f"printf('%.2f', {x})"
add("bbox_format", f"SELECT c_custkey, {_P2('lon')} || ',' || {_P2('lat')} || ',' || {_P2('lon + 1.5')} || ',' || {_P2('lat + 2.25')} AS text FROM {POINTS}")(lambda s, d: t.points(s, d).select("c_custkey", nm.format_box(_BOX(), 2).alias("text")))
_S = lambda x: f"CAST({x} AS VARCHAR)"
_RING = [("lon", "lat"), ("lon + 1.5", "lat"), ("lon + 1.5", "lat + 2.25"), ("lon", "lat + 2.25"), ("lon", "lat")]
add("bbox_wkt", f"SELECT c_custkey, 'POLYGON((' || {' || chr(44) || '.join(_S(x) + " || ' ' || " + _S(y) for x, y in _RING)} || '))' AS wkt FROM {POINTS}")(lambda s, d: t.points(s, d).select("c_custkey", nm.box_wkt(_BOX()).alias("wkt")))
_CO = "'[[' || " + " || ',' || ".join(f"'[' || {_S(x)} || ',' || {_S(y)} || ']'" for x, y in _RING) + " || ']]'"
add("bbox_geojson", f"SELECT c_custkey, '{{\"type\":\"Polygon\",\"coordinates\":' || {_CO} || '}}' AS geojson, lon AS x0, lat + 2.25 AS y1 FROM {POINTS}")(
    lambda s, d: t.points(s, d).withColumn("geojson", nm.box_geojson(_BOX())).withColumn("b", nm.geojson_box(_c("geojson"))).select("c_custkey", "geojson", _c("b")[0].alias("x0"), _c("b")[3].alias("y1"))
)
_NAME = "(CASE event_id % 2 WHEN 0 THEN 'S1A' ELSE 'S1B' END || '_IW_SLC__1SDV_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || strftime(ts + INTERVAL 27 SECOND, '%Y%m%dT%H%M%S') || '_' || lpad(CAST(event_id % 50000 + 1000 AS VARCHAR), 6, '0') || '_05F2A1_C3D4')"
_at = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
_name = lambda: F.concat(F.when(_c("event_id") % 2 == 0, "S1A").otherwise("S1B"), F.lit("_IW_SLC__1SDV_"), _at("ts"), F.lit("_"), _at(_c("ts") + F.expr("INTERVAL 27 SECOND")), F.lit("_"), F.lpad((_c("event_id") % 50000 + 1000).cast("string"), 6, "0"), F.lit("_05F2A1_C3D4"))
add("product_names", f"SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'S1A' ELSE 'S1B' END AS platform, date_trunc('second', ts) AS acquired, CAST((event_id % 50000 + 1000 - CASE event_id % 2 WHEN 0 THEN 73 ELSE 27 END) % 175 + 1 AS INT) AS track FROM events")(
    lambda s, d: t.read(s, d, "events").withColumn("n", _name()).select("event_id", nm.platform_of(_c("n")).alias("platform"), nm.acquired_at(_c("n")).alias("acquired"), nm.relative_orbit(_c("n")).alias("track"))
)
_orbit = lambda: F.concat(F.lit("S1A_OPER_AUX_POEORB_OPOD_20240101T000000_V"), _at(F.date_trunc("day", "ts") - F.expr("INTERVAL 1 HOUR")), F.lit("_"), _at(F.date_trunc("day", "ts") + F.expr("INTERVAL 13 HOUR")), F.lit(".EOF"))
add("orbit_file_covers", "SELECT event_id, ts <= date_trunc('day', ts) + INTERVAL 13 HOUR AS covered FROM events")(lambda s, d: t.read(s, d, "events").select("event_id", nm.covers(_orbit(), _c("ts")).alias("covered")))
add("satellite_short_names", f"SELECT id, CASE satellite WHEN 'Sentinel-1A' THEN 'S1A' WHEN 'Sentinel-2B' THEN 'S2B' WHEN 'Landsat-8' THEN 'L8' ELSE '' END AS name FROM {SCENES}")(lambda s, d: t.scenes(s, d).select("id", nm.short_name(_c("satellite")).alias("name")))
add("band_names_padded", "SELECT event_id, 'B' || CASE WHEN event_id % 13 < 10 THEN '0' ELSE '' END || CAST(event_id % 13 AS VARCHAR) AS padded, 'B' || CAST(event_id % 13 AS VARCHAR) AS stripped FROM events")(
    lambda s, d: t.read(s, d, "events").withColumn("b", F.concat(F.lit("B"), (_c("event_id") % 13).cast("string"))).select("event_id", nm.zero_padded(_c("b")).alias("padded"), nm.zero_stripped(nm.zero_padded(_c("b"))).alias("stripped"))
)
add("validate_strings", "SELECT event_id, event_id % 120 <= 100 AS cloud_ok, CASE WHEN event_id % 120 <= 100 THEN CAST(event_id % 120 AS DOUBLE) END AS most, CASE WHEN event_id % 3 > 0 THEN CAST(ts AS DATE) END AS day FROM events")(
    lambda s, d: t.read(s, d, "events").withColumn("r", nm.cloud_range(F.concat(F.lit("0-"), (_c("event_id") % 120).cast("string")))).select("event_id", _c("r").isNotNull().alias("cloud_ok"), _c("r")[1].alias("most"), nm.iso_date(F.when(_c("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy/MM/dd"))).alias("day"))
)
add("relative_date_ranges", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN DATE '2024-01-25' WHEN 1 THEN DATE '2023-02-01' ELSE CAST(ts AS DATE) END AS first, CASE event_id % 3 WHEN 2 THEN DATE '2024-03-01' ELSE DATE '2024-02-01' END AS last FROM events")(
    lambda s, d: t.read(s, d, "events").withColumn("n", F.when(_c("event_id") % 3 == 0, "last_7_days").when(_c("event_id") % 3 == 1, "last_year").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(",2024-03-01")))).select("event_id", *[x.alias(n) for x, n in zip(nm.date_range(_c("n"), F.lit("2024-02-01").cast("date")), ("first", "last"))])
)
add("julian_start_times", "SELECT event_id, date_trunc('second', ts) AS start FROM events")(lambda s, d: t.read(s, d, "events").select("event_id", nm.julian_start(F.concat(F.lit("OR_ABI-L2-CMIPF-M6C13_G16_s"), F.date_format("ts", "yyyyDDDHHmmss"), F.lit("3_e1_c1.nc"))).alias("start")))
add("hour_prefixes", "SELECT event_id, 'ABI/' || strftime(date_trunc('hour', ts) + INTERVAL (i) HOUR, '%Y/%j/%H') || '/' AS prefix FROM events, (SELECT unnest(range(0, 3)) AS i)")(lambda s, d: t.read(s, d, "events").select("event_id", F.explode(nm.hour_prefixes("ABI", _c("ts"), _c("ts") + F.expr("INTERVAL 2 HOUR"))).alias("prefix")))
add("fingerprints", "SELECT event_id, sha256('[\"' || CAST(event_id AS VARCHAR) || '\",\"' || event_type || '\"]') AS h FROM events")(lambda s, d: t.read(s, d, "events").select("event_id", nm.fingerprint(_c("event_id"), _c("event_type")).alias("h")))
_KEY, _TYPE, _EXT = "CASE event_id % 5 WHEN 0 THEN 'thumbnail' WHEN 1 THEN 'B04' WHEN 2 THEN 'metadata' WHEN 3 THEN 'red' ELSE 'data' END", "CASE event_id % 5 WHEN 1 THEN 'image/tiff; application=geotiff' WHEN 2 THEN 'application/xml' END", "CASE event_id % 5 WHEN 0 THEN 'png' WHEN 2 THEN 'xml' WHEN 4 THEN 'json' ELSE 'tif' END"
add("data_assets", "SELECT event_id, event_id % 5 IN (1, 3) AND event_id % 7 > 0 AS is_data FROM events")(
    lambda s, d: t.read(s, d, "events").select("event_id", nm.is_data(F.expr(_KEY), F.expr(_TYPE), F.when(_c("event_id") % 7 == 0, F.array(F.lit("overview"))).otherwise(F.array(F.lit("data"))), F.concat(F.lit("https://x/y."), F.expr(_EXT))).alias("is_data"))
)
add("quality_grades", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'degraded' WHEN event_id % 2 = 0 THEN 'quicklook' ELSE 'science' END AS grade FROM events")(
    lambda s, d: t.read(s, d, "events").select("event_id", nm.grade(F.array(F.lit(True), _c("event_id") % 3 > 0), F.when(_c("event_id") % 2 == 0, F.array(F.lit("coarse"))).otherwise(F.array().cast("array<string>"))).alias("grade"))
)
