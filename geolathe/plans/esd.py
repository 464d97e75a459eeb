"""Queries of burst overlaps: complex bursts of the tables' rasters with planted azimuth shifts, which come back."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import esd
from ..sources import tables as t
from .base import PIXELS, add, r6, sr

_c = F.col
LINES, AHEAD, COLS, DT = 8, 5, 32, 0.002
AMBIGUITY = 1 / (esd.DELTA_F * DT)


def _stack(s, d) -> DataFrame:
    """Three bursts of eight lines, each four rasters wide; the second image is turned by the Doppler of each line times the shift."""
    k = _c("scene_id")
    p = t.rasters(s, d).select(F.floor(k / 12).alias("pair"), F.floor(k % 12 / 4).alias("burst"), _c("row").alias("line"), (k % 4 * 8 + _c("col")).cast("int").alias("col"), "v")
    row = _c("burst") * LINES + _c("line")
    shift = (_c("pair") % 5 - 2) * 0.01 + (F.floor(_c("col") / 8) - 1.5) * (_c("pair") % 3) * 0.004 + (_c("burst") - 1) * 0.0
    turn = -2 * pi * esd.DELTA_F * DT * shift * _c("line") / AHEAD
    size = 1 + F.abs("v")
    return p.select(_c("pair").alias("scene_id"), row.cast("int").alias("row"), "col", (size * F.cos("v")).alias("ref_re"), (size * F.sin("v")).alias("ref_im"), (size * F.cos(_c("v") - turn)).alias("sec_re"), (size * F.sin(_c("v") - turn)).alias("sec_im"))


def _bursts(s, d) -> DataFrame:
    k = _c("scene_id")
    return t.rasters(s, d).select(F.floor(k / 12).alias("scene_id"), F.floor(k % 12 / 4).cast("int").alias("burst")).distinct().select("scene_id", "burst", (_c("burst") * AHEAD * DT + 100.0).alias("start"), F.lit(LINES).alias("lines"), F.lit(DT).alias("dt"))


def _differences(s, d) -> DataFrame:
    return esd.double_differences(_stack(s, d), esd.overlap_lines(_bursts(s, d)))


_SEEN = f"(SELECT scene_id // 12 AS pair, scene_id % 12 // 4 AS burst, scene_id % 4 AS block, count(*) AS n FROM {PIXELS} GROUP BY ALL)"
# an overlap's block is there if both its bursts' rasters are
_BLOCKS = f"(SELECT a.pair, a.burst, a.block, (a.pair % 5 - 2) * 0.01 + (a.block - 1.5) * (a.pair % 3) * 0.004 AS shift FROM {_SEEN} a JOIN {_SEEN} b ON a.pair = b.pair AND a.block = b.block AND b.burst = a.burst + 1)"
add("esd_block_shifts", f"SELECT pair AS scene_id, CAST(burst AS INT) AS overlap, CAST(block AS INT) AS block, {sr('CAST(shift AS DOUBLE)')} AS shift_px, CAST(24 AS BIGINT) AS n FROM {_BLOCKS}")(
    lambda s, d: esd.block_shifts(_differences(s, d), COLS, 4).select("scene_id", "overlap", "block", r6(_c("shift_px")).alias("shift_px"), "n")
)
_WHOLE = f"(SELECT pair FROM {_BLOCKS} GROUP BY pair HAVING count(*) = 8)"
add("esd_fields", f"SELECT DISTINCT pair AS scene_id, {sr('CAST((pair % 5 - 2) * 0.01 AS DOUBLE)')} AS const_px, {sr('CAST((pair % 3) * 0.016 AS DOUBLE)')} AS range_px, 0.0::DOUBLE AS azimuth_px, CAST(8 AS BIGINT) AS n_used FROM {_WHOLE}")(
    lambda s, d: esd.fit_field(esd.block_shifts(_differences(s, d), COLS, 4), 3 * LINES, COLS, AMBIGUITY).filter("n_blocks = 8")
    # columns' centres lie half a column before the middle
    .select("scene_id", r6(_c("const") - _c("range") * 0.5 / COLS).alias("const_px"), r6(_c("range")).alias("range_px"), r6(_c("azimuth")).alias("azimuth_px"), "n_used")
)
add("esd_overlap_shifts", f"SELECT pair AS scene_id, CAST(burst AS INT) AS overlap, {sr('CAST((pair % 5 - 2) * 0.01 * 0.002 * 1000 AS DOUBLE)')} AS shift_ms FROM {_BLOCKS} WHERE pair % 3 = 0 GROUP BY pair, burst")(
    lambda s, d: esd.overlap_shifts(_differences(s, d)).filter("scene_id % 3 = 0").select("scene_id", "overlap", r6(_c("shift_s") * 1000).alias("shift_ms"))
)
