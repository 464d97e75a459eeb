"""Queries of phase rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phase
from ..sources import tables as t
from .base import KEY, PIXELS, add, box, pixel_query, r6, sr

_PIX = f"SELECT * FROM {PIXELS}"
# sigma 0.5: a radius of 2
_W = "exp(-0.5 * (dr * dr + dc * dc) / 0.25)"
pixel_query("phase_lowpass", "low", box(_PIX, f"sum(b.v * {_W}) / sum({_W}) AS low", 5), lambda p: phase.lowpass(p, 0.5))
pixel_query("phase_smooth_wrapped", "low", box(_PIX, f"atan2(sum(sin(b.v) * {_W}), sum(cos(b.v) * {_W})) AS low", 5), lambda p: phase.lowpass(p, 0.5, True))
_PICK = f"SELECT *, (row + col + scene_id) % 3 = 0 AS picked FROM {PIXELS}"
pixel_query("atmospheric_screen", "screen", box(_PICK, f"sum(CASE WHEN b.picked THEN b.v * {_W} END) / sum(CASE WHEN b.picked THEN {_W} END) AS screen", 5), lambda p: phase.screen(p.withColumn("picked", (F.col("row") + F.col("col") + F.col("scene_id")) % 3 == 0), 0.5))
_NEAR = f"SELECT a.scene_id, a.row, a.col, {{}} FROM {PIXELS} a JOIN {PIXELS} b ON a.scene_id = b.scene_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY a.scene_id, a.row, a.col"
pixel_query("neighbourhood_mean", "near", _NEAR.format("avg(b.v) AS near"), lambda p: phase.neighbourhood_mean(p, 3))
_N = _NEAR.format("any_value(a.v) AS v, sum(cos(b.v)) AS x, sum(sin(b.v)) AS y")
_RES = f"(SELECT scene_id, row, col, cos(v - atan2(y, x)) AS re, sin(v - atan2(y, x)) AS im FROM ({_N}))"
add("residual_phase_coherence", f"SELECT row, col, {sr('sqrt(pow(avg(re), 2) + pow(avg(im), 2))')} AS gamma FROM {_RES} GROUP BY row, col")(lambda s, d: phase.residual_coherence(t.rasters(s, d), 3).withColumn("gamma", r6(F.col("gamma"))))
add("goldstein_filter", None)(lambda s, d: phase.goldstein(t.rasters(s, d), window=4))
# sixteen rasters as one of 32 x 32, against itself moved by rows and columns of its number: what the tracker must find inside
_LARGE = "scene_id // 16 AS scene_id, scene_id % 16 // 4 * 8 + row AS row, scene_id % 4 * 8 + col AS col"
add("offset_tracking", f"SELECT scene_id, row, col, CAST(scene_id % 5 - 2 AS DOUBLE) AS d_row, CAST(scene_id % 4 - 1 AS DOUBLE) AS d_col FROM (SELECT {_LARGE} FROM {PIXELS}) WHERE row IN (12, 16, 20) AND col IN (12, 16, 20)")(
    lambda s, d: phase.offsets(_moved(s, d), chip=12, reach=3, step=4, least_known=0.5).filter("row BETWEEN 12 AND 20 AND col BETWEEN 12 AND 20").select("scene_id", "row", "col", *[(F.round(c) + F.lit(0.0)).alias(c) for c in ("d_row", "d_col")])
)


def _moved(s, d):
    k = F.col("scene_id")
    p = t.rasters(s, d).select(F.floor(k / 16).alias("scene_id"), (F.floor(k % 16 / 4) * 8 + F.col("row")).cast("int").alias("row"), (k % 4 * 8 + F.col("col")).cast("int").alias("col"), "v")
    b = p.select("scene_id", F.pmod(F.col("row") + F.col("scene_id") % 5 - 2, F.lit(32)).cast("int").alias("row"), F.pmod(F.col("col") + F.col("scene_id") % 4 - 1, F.lit(32)).cast("int").alias("col"), F.col("v").alias("b"))
    return p.withColumnRenamed("v", "a").join(b, ["scene_id", "row", "col"], "full")  # the last raster may lack tiles, here and where they moved
