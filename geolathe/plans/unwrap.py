"""Queries of unwrapping errors that are planted in the tables' rasters and networks: what comes back is what was planted."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import unwrap
from ..sources import tables as t
from .base import PIXELS, add, r6, sr

_c = F.col


def _raster(s, d) -> DataFrame:
    """Three regions a raster with empty columns between them, a gentle ramp, and whole cycles by region."""
    p = t.rasters(s, d).filter("col NOT IN (2, 6)").withColumn("region", F.when(_c("col") < 2, 3).when(_c("col") < 6, 1).otherwise(2))
    return p.select("scene_id", "row", "col", (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c("v"))) * 0.2 + _c("row") * 0.1 + _c("col") * 0.2 + (_c("scene_id") * _c("region") % 5 - 2) * 2 * pi).alias("phase"), "region")


_REGION = "(CASE WHEN col < 2 THEN 3 WHEN col < 6 THEN 1 ELSE 2 END)"
_TRUE = "greatest(-1, least(1, v)) * 0.2 + row * 0.1 + col * 0.2"
add("unwrap_bridged", f"SELECT scene_id, row, col, {sr(f'{_TRUE} + (scene_id % 5 - 2) * 2 * pi()')} AS phase FROM {PIXELS} WHERE col NOT IN (2, 6)")(
    lambda s, d: unwrap.bridged(_raster(s, d), radius=3, least_size=4).select("scene_id", "row", "col", r6(_c("bridged")).alias("phase"))
)
add("unwrap_region_cycles", f"SELECT scene_id, region, CAST(scene_id % 5 - scene_id * region % 5 AS BIGINT) AS cycles FROM (SELECT DISTINCT scene_id, CAST({_REGION} AS BIGINT) AS region FROM {PIXELS} WHERE col NOT IN (2, 6))")(
    lambda s, d: unwrap.bridge_cycles(_raster(s, d), radius=3, least_size=4)
)


def _jumped(s, d) -> DataFrame:
    """Networks of closed phases, in each of which the pair of the fifth and sixth date is off by some cycles."""
    first = F.row_number().over(W.partitionBy("pixel", "d1").orderBy("d2")) == 1
    ifg = t.interferograms(s, d).withColumns({"k": F.dense_rank().over(W.partitionBy("pixel").orderBy("d1")), "first": first})
    off = F.when(F.expr("k = 5 AND first"), _c("pixel") % 2 * 2 - 1 + _c("pixel") % 5 - 2).otherwise(0)
    return ifg.withColumn("off", off).drop("k", "first").withColumn("phase", _c("phase") + _c("off") * 2 * pi)


_LEVELS = "(SELECT pixel, day, row_number() OVER (PARTITION BY pixel ORDER BY day) AS k, lead(day) OVER (PARTITION BY pixel ORDER BY day) AS next, count(*) OVER (PARTITION BY pixel) AS n FROM (SELECT DISTINCT l_partkey AS pixel, CAST(datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS INT) AS day FROM lineitem))"
add("unwrap_closing_cycles", f"SELECT pixel, day AS d1, next AS d2, CAST(-(pixel % 2 * 2 - 1 + pixel % 5 - 2) AS BIGINT) AS cycles FROM {_LEVELS} WHERE k = 5 AND n >= 9 AND pixel % 2 * 2 - 1 + pixel % 5 - 2 <> 0")(
    lambda s, d: unwrap.closing_cycles(_jumped(s, d)).join(t.interferograms(s, d).groupBy("pixel").agg(F.countDistinct("d1").alias("n")).filter("n >= 8").select("pixel"), "pixel", "left_semi")
)
