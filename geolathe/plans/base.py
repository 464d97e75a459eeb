"""What all registered queries share: the registry, and the domain's tables in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-02-01"

SCENES = """(SELECT CAST(event_id AS VARCHAR) AS id, event_type AS provider, user_id AS track, ts AS datetime, least(value, 100.0) AS cloud_cover,
 CASE event_id % 3 WHEN 0 THEN 'L1C' WHEN 1 THEN 'L2A' ELSE 'L2SP' END AS processing_level,
 CASE event_id % 4 WHEN 0 THEN 'Sentinel-1A' WHEN 1 THEN 'Sentinel-2B' WHEN 2 THEN 'Landsat-8' ELSE NULL END AS satellite,
 CASE event_id % 4 WHEN 0 THEN 'C-SAR' WHEN 1 THEN 'MSI' WHEN 2 THEN 'OLI-TIRS' ELSE NULL END AS sensor,
 CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'GRD' ELSE 'SLC' END END AS product_type,
 CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 16 < 8 THEN 'VV' ELSE 'VV+VH' END END AS polarisation,
 CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 5 < 2 THEN 'ascending' ELSE 'descending' END END AS pass_direction,
 event_type || '-' || CAST(event_id % 2 + 1 AS VARCHAR) AS collection, CAST(event_id % 6 * 10 + 10 AS DOUBLE) AS resolution_m,
 CAST(event_id % 360 - 180 AS DOUBLE) AS min_lon, CAST(event_id % 170 - 85 AS DOUBLE) AS min_lat, CAST(event_id % 360 - 179 AS DOUBLE) AS max_lon, CAST(event_id % 170 - 84 AS DOUBLE) AS max_lat, props AS properties FROM events)"""
BANDS = """(SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS date, l_discount * 0.9 + 0.01 AS blue, l_quantity / 50 AS green, l_discount AS red, l_tax AS nir,
 l_extendedprice / 1e5 AS swir1, l_extendedprice / 2e5 + l_tax AS swir2, l_extendedprice / 3e5 + 0.01 AS swir3, l_tax * 0.5 + 0.05 AS swir4, l_discount * 0.5 + 0.02 AS swir5,
 l_tax * 0.8 + 0.01 AS nir1, (l_discount + l_tax) / 2 + 0.005 AS red_edge, l_extendedprice AS dn FROM lineitem)"""
PIXELS = "(SELECT vec_id AS scene_id, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
PAIRS = f"(SELECT a.scene_id, a.row, a.col, a.v AS a, b.v AS b FROM {PIXELS} a JOIN {PIXELS} b ON b.scene_id = a.scene_id + 1 AND a.row = b.row AND a.col = b.col WHERE a.scene_id % 2 = 0)"
DATES = "(SELECT DISTINCT user_id AS track, CAST(ts AS DATE) AS date FROM events)"
POINTS = "(SELECT c_custkey, CAST(c_custkey % 170 - 85 AS DOUBLE) AS lat, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon, c_acctbal FROM customer)"
PX = "l_orderkey, l_linenumber"
KEY = "scene_id, row, col"


def add(name: str, sql: str | None):
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def sr(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def bands_query(name: str, columns: Callable[[], dict], sql: dict[str, str], whole: bool = False) -> None:
    """A projection of the bands. ``whole``: the columns are no doubles and are left as they are."""
    rounded, srounded = (lambda v: v, lambda v: v) if whole else (r6, sr)
    add(name, f"SELECT {PX}, {', '.join(f'{srounded(v)} AS {k}' for k, v in sql.items())} FROM {BANDS}")(lambda s, d: t.bands(s, d).select("l_orderkey", "l_linenumber", *[rounded(v).alias(k) for k, v in columns().items()]))


def points_query(name: str, columns: Callable[[], dict], sql: dict[str, str], digits: int = 6) -> None:
    """A projection of the points, doubles rounded."""
    add(name, f"SELECT c_custkey, {', '.join(f'round({v}, {digits}) + 0.0 AS {k}' for k, v in sql.items())} FROM {POINTS}")(lambda s, d: t.points(s, d).select("c_custkey", *[(F.round(v, digits) + F.lit(0.0)).alias(k) for k, v in columns().items()]))


def pixel_query(name: str, columns: str, sql: str, f: Callable[[DataFrame], DataFrame], source: Callable = t.rasters) -> None:
    """Doubles of every pixel, rounded."""
    cols = columns.split()
    add(name, f"SELECT {KEY}, {', '.join(f'{sr(c)} AS {c}' for c in cols)} FROM ({sql})")(lambda s, d: f(source(s, d)).select("scene_id", "row", "col", *[r6(F.col(c)).alias(c) for c in cols]))


def mirrored(at: str) -> str:
    """A row or column of an 8 x 8 raster, reflected at its border."""
    return f"(CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} > 7 THEN 15 - ({at}) ELSE {at} END)"


def edged(at: str) -> str:
    """The same, held at the outermost."""
    return f"greatest(0, least(7, {at}))"


def box(source: str, columns: str, k: int, border: Callable[[str], str] = mirrored) -> str:
    """Aggregates ``columns`` of each pixel ``a`` over the pixels ``b`` of its k x k box, at offsets dr, dc."""
    r = k // 2
    return f"SELECT a.scene_id, a.row, a.col, {columns} FROM ({source}) a, (SELECT unnest(range(-{r}, {r + 1})) AS dr), (SELECT unnest(range(-{r}, {r + 1})) AS dc), ({source}) b WHERE b.scene_id = a.scene_id AND b.row = {border('a.row + dr')} AND b.col = {border('a.col + dc')} GROUP BY a.scene_id, a.row, a.col"
