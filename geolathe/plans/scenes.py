"""Queries of scene catalogs: search in full, federation, preflight, organisation and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, preflight
from ..sources import catalog_source, sinks
from ..sources import tables as t
from ..streaming import monitor
from .base import AS_OF, SCENES, add, sr

_SCORE = f"least(1.0, CASE WHEN cloud_cover IS NULL THEN 0.5 ELSE 0.5 * 0.6 + 0.4 * (100 - cloud_cover) / 100 END + 0.3 * greatest(0.0, 1 - greatest(0, date_diff('day', CAST(datetime AS DATE), DATE '{AS_OF}')) / 365.0) + CASE WHEN processing_level IN ('L2','L2A','L2SP','ARD') THEN 0.1 ELSE 0.0 END)"
RADAR = catalog.SceneQuery(satellites=("sentinel-1a",), product_type="SLC", polarisation="VH+VV", pass_direction="Descending", resolution_min=20.0, resolution_max=50.0, limit=500)
_RADAR = "upper(satellite) = 'SENTINEL-1A' AND product_type = 'SLC' AND polarisation = 'VV+VH' AND pass_direction = 'descending' AND resolution_m BETWEEN 20 AND 50"
OPTICAL = catalog.SceneQuery(geometry=((-100.0, -40.0), (80.0, -40.0), (0.0, 60.0)), sensors=("msi", "oli-tirs"), levels=("l2a", "L2SP"), cloud_min=5.0, expression="track % 2 = 0", sort_by="datetime", ascending=True, limit=30, page=2)
_OPTICAL = "min_lon <= 80 AND max_lon >= -100 AND min_lat <= 60 AND max_lat >= -40 AND sensor IN ('MSI', 'OLI-TIRS') AND processing_level IN ('L2A', 'L2SP') AND cloud_cover >= 5 AND track % 2 = 0"

add("catalog_radar_filter", f"SELECT id, satellite, polarisation FROM {SCENES} WHERE {_RADAR}")(lambda s, d: t.scenes(s, d).filter(RADAR.predicate()).select("id", "satellite", "polarisation"))
add("catalog_sorted_page", f"SELECT id, datetime FROM {SCENES} WHERE {_OPTICAL} ORDER BY datetime NULLS LAST, id LIMIT 30 OFFSET 30")(lambda s, d: catalog.search(t.scenes(s, d), OPTICAL, AS_OF).select("id", "datetime"))
FEDERATED = catalog.SceneQuery(cloud_max=50.0, overrides={"late": {"cloud_max": 80.0}}, limit=400)
add("catalog_federated", f"SELECT id, arrival, round(score, 9) AS score FROM (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY provider, id ORDER BY arrival) AS r FROM (SELECT *, 0 AS arrival FROM {SCENES} WHERE track % 3 < 2 AND (cloud_cover IS NULL OR cloud_cover <= 50) UNION ALL SELECT *, 1 FROM {SCENES} WHERE track % 3 > 0 AND (cloud_cover IS NULL OR cloud_cover <= 80))) WHERE r = 1 ORDER BY score DESC, id LIMIT 400")(
    lambda s, d: catalog.federated({"early": t.scenes(s, d).filter("track % 3 < 2"), "late": t.scenes(s, d).filter("track % 3 > 0")}, FEDERATED, AS_OF).select("id", "arrival", F.round("score", 9).alias("score"))
)
add("catalog_keep_known", f"SELECT id FROM {SCENES} WHERE coalesce(satellite = 'Landsat-8', true)")(lambda s, d: catalog.keep_known(t.scenes(s, d), "satellite = 'Landsat-8'").select("id"))
add("catalog_folders", f"SELECT id, strftime(datetime, '%Y-%m-%d') || '/' || CAST(track AS VARCHAR) || '/' || coalesce(satellite, 'unknown-satellite') || '/' || processing_level AS folder FROM {SCENES}")(lambda s, d: catalog.organised(t.scenes(s, d)).select("id", "folder"))
add("consistent_track_scenes", f"WITH n AS (SELECT provider, track, count(*) AS n FROM {SCENES} GROUP BY ALL), p AS (SELECT provider, track FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY n DESC, track) AS r FROM n) WHERE r = 1 AND n >= 2) SELECT provider, track, id FROM (SELECT s.*, row_number() OVER (PARTITION BY s.provider ORDER BY datetime, id) AS r FROM {SCENES} s JOIN p ON s.provider = p.provider AND s.track = p.track) WHERE r <= 5")(
    lambda s, d: catalog.largest_track(t.scenes(s, d), 5).select("provider", "track", "id")
)

RULES = preflight.Rules(area=(0.0, 0.0, 0.5, 0.5), least_coverage=0.9, cloud_max=40.0, cloud_is_error=False, bands=("red", "B08"), level="Level-2A", start="2024-01-03", end="2024-01-28")
_COV = "greatest(0.0, least(max_lon, 0.5) - greatest(min_lon, 0.0)) * greatest(0.0, least(max_lat, 0.5) - greatest(min_lat, 0.0)) / 0.25"
_INNER = "greatest(0.0, least(max_lon - 0.01, 0.5) - greatest(min_lon + 0.01, 0.0)) * greatest(0.0, least(max_lat - 0.01, 0.5) - greatest(min_lat + 0.01, 0.0)) / 0.25"
_CHECKS = [(f"{_COV} < 0.9", "e"), ("coalesce(cloud_cover, 0) > 40", "w"), ("CAST(id AS BIGINT) % 101 > 50", "w"), ("CAST(id AS BIGINT) % 5 = 0", "e"), ("processing_level <> 'L2A'", "e"), (f"{_INNER} < 0.5", "w"), ("CAST(datetime AS DATE) < DATE '2024-01-03' OR CAST(datetime AS DATE) > DATE '2024-01-28'", "e")]
_sum = lambda kind: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, k in _CHECKS if k == kind)
_CODES = "[x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for (c, _), n in zip(_CHECKS, ("LOW_AOI_COVERAGE", "CLOUD_COVER_EXCEEDED", "SNOW_ICE_COVER_EXCEEDED", "MISSING_BANDS", "PROCESSING_LEVEL_MISMATCH", "NODATA_MARGIN_RISK", "OUT_OF_TEMPORAL_BOUNDS"))) + "] IF x IS NOT NULL]"


def _checked(s, d):
    at = F.col("id").cast("long")
    return t.scenes(s, d).withColumn("snow_cover", (at % 101).cast("double")).withColumn("bands", F.when(at % 5 == 0, F.array(F.lit("red"), F.lit("SCL"))).otherwise(F.array(F.lit("nir"), F.lit("b4"), F.lit("B03"))))


add("preflight_issues", f"SELECT id, array_to_string({_CODES}, ' ') AS codes, {_sum('e')} AS n_errors, {_sum('w')} AS n_warnings, {sr(_COV)} AS coverage, ({_sum('e')}) = 0 AS passed FROM {SCENES}")(
    lambda s, d: preflight.validated(_checked(s, d), RULES).select("id", F.concat_ws(" ", F.transform("issues", lambda i: i.code)).alias("codes"), "n_errors", "n_warnings", (F.round("aoi_coverage", 6) + F.lit(0.0)).alias("coverage"), "passed")
)
_EASY = preflight.Rules(area=(-60.0, -60.0, 60.0, 60.0), least_coverage=0.0, margin_deg=None, cloud_max=30.0, level="L2A")
add("preflight_passing", f"SELECT id FROM {SCENES} WHERE coalesce(cloud_cover, 0) <= 30 AND processing_level = 'L2A'")(lambda s, d: preflight.passing(t.scenes(s, d), _EASY).select("id"))
add("preflight_severity", f"SELECT track, CASE max(CASE WHEN {_sum('e')} > 0 THEN 2 WHEN {_sum('w')} > 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS severity FROM {SCENES} GROUP BY track")(lambda s, d: preflight.severity(preflight.validated(_checked(s, d), RULES), "track"))
add("matching_bands", f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'red' ELSE 'nir b4' END AS keys FROM {SCENES}")(lambda s, d: _checked(s, d).select("id", F.concat_ws(" ", preflight.matching_bands(F.col("bands"), ("B04", "NIR"))).alias("keys")))
add("coherence_faults", "SELECT vec_id AS scene_id, CAST(len([x FOR x IN embedding IF x < 0 OR x > 1]) AS BIGINT) AS n_outside FROM embeddings")(lambda s, d: preflight.coherence_faults(t.rasters(s, d)))
add("slc_faults", "SELECT vec_id AS scene_id, CASE WHEN vec_id % 3 = 0 THEN 'no imaginary part' ELSE '' END AS faults FROM embeddings")(
    lambda s, d: preflight.complex_faults(t.rasters(s, d).select("scene_id", F.col("v").alias("re"), F.when(F.col("scene_id") % 3 > 0, F.col("v") * 0.5).otherwise(0.0).alias("im"))).select("scene_id", F.concat_ws(",", "faults").alias("faults"))
)

_XY = [("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat")]
_RING = " || ',' || ".join(f"'[' || CAST({x} AS VARCHAR) || ',' || CAST({y} AS VARCHAR) || ']'" for x, y in _XY)
_GEOM = f"'\"geometry\":{{\"type\":\"Polygon\",\"coordinates\":[[' || {_RING} || ']]}}'"
add("stac_item_geometry", f"SELECT id, {_GEOM} AS geometry FROM {SCENES}")(lambda s, d: sinks.stac_items(t.scenes(s, d)).select("id", F.regexp_extract("item", r'("geometry":\{.*?\]\]\})', 1).alias("geometry")))
add("stac_items_read_back", f"SELECT id, collection, processing_level AS level, satellite FROM {SCENES}")(
    lambda s, d: sinks.stac_items(t.scenes(s, d)).select(*[F.get_json_object("item", p).alias(n) for n, p in (("id", "$.id"), ("collection", "$.collection"), ("level", "$.properties.processing:level"), ("satellite", "$.properties.platform"))])
)
add("geojson_features", f"SELECT id, '{{\"type\":\"Feature\",' || {_GEOM} AS head FROM {SCENES}")(lambda s, d: sinks.features(t.scenes(s, d)).select("id", F.regexp_extract("feature", r"^(.*?\]\]\})", 1).alias("head")))
add("scene_manifest", f"SELECT count(*) AS n_rows FROM {SCENES}")(lambda s, d: sinks.manifest(t.scenes(s, d), ["id", "provider"]).select("n_rows"))


@add("catalog_source_search", f"SELECT id, provider, collection, datetime, cloud_cover, min_lon, max_lat FROM {SCENES} WHERE provider IN ('click', 'purchase') AND datetime >= TIMESTAMP '2024-01-10' AND datetime < TIMESTAMP '2024-01-25' AND cloud_cover < 40")
def catalog_source_search(s, d):
    """The whole catalog is written as items and searched through the source of its own."""
    at = monitor.fresh_folder(s, "catalog")
    catalog_source.write_catalog(t.scenes(s, d), at)
    found = catalog_source.read_catalog(s, at).filter("provider IN ('click', 'purchase') AND datetime >= TIMESTAMP_NTZ '2024-01-10' AND datetime < TIMESTAMP_NTZ '2024-01-25' AND cloud_cover < 40")
    return found.select("id", "provider", "collection", "datetime", "cloud_cover", "min_lon", "max_lat")
