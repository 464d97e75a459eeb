"""Grids of pixels: stacks of bands and dates, clipping, tiles, masks of radar geometry, processing chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import radiometry as rd
from . import detect, raster
from . import vectors as ve

CELL = ["row", "col"]


def stacked(bands: dict[str, DataFrame], by: Sequence[str] = CELL) -> DataFrame:
    """One row a pixel with a column for each band (by, v), on the first one's grid."""
    first, *rest = bands.items()
    out = first[1].select(*by, F.col("v").alias(first[0]))
    for name, b in rest:
        out = out.join(b.select(*by, F.col("v").alias(name)), list(by), "left")
    return out


def in_time(dates: dict[str, DataFrame], by: Sequence[str] = CELL) -> DataFrame:
    """(by, date, v) of rasters by their ISO dates."""
    parts = [d.select(*by, F.lit(day).cast("date").alias("date"), "v") for day, d in sorted(dates.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clipped(pixels: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, ring: Column | None = None, outside: float | None = None) -> DataFrame:
    """Pixels of a window (first, one past the last) or whose centre lies in a polygon over (col, row); with ``outside`` the others stay with that value."""
    keep = F.lit(True)
    for c, span in (("row", rows), ("col", cols)):
        if span:
            keep = keep & (F.col(c) >= span[0]) & (F.col(c) < span[1])
    if ring is not None:
        keep = keep & ve.contains(ring, F.col("col") + 0.5, F.col("row") + 0.5)
    return pixels.filter(keep) if outside is None else pixels.withColumn("v", F.when(keep, F.col("v")).otherwise(F.lit(outside)))


def tiles(pixels: DataFrame, size: int, overlap: int, least: float = 0.1) -> DataFrame:
    """``pixels`` with the tiles (tile_row, tile_col) that hold them, which start at multiples of size - overlap; tiles of which fewer than a share ``least`` is known are left out."""
    stride = size - overlap
    out = pixels
    for c in ("row", "col"):
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride))
        out = out.withColumn(f"tile_{c}", F.explode(F.sequence(first.cast("int"), F.floor(F.col(c) / stride).cast("int"))))
    key = ["scene_id", "tile_row", "tile_col"]
    full = out.groupBy(*key).agg((F.count("v") / F.count("*")).alias("_known")).filter(F.col("_known") >= least).drop("_known")
    return out.join(full, key)


def local_incidence(slope_deg: Column, aspect_deg: Column, incidence_deg: Column, heading_deg: Column) -> Column:
    """The angle between the line of sight of a right-looking sensor and the terrain's normal, along the look direction."""
    return incidence_deg + slope_deg * F.cos(F.radians(aspect_deg - (heading_deg + 90)))


def visible(slope_deg: Column, aspect_deg: Column, incidence_deg: Column, heading_deg: Column) -> Column:
    """Neither in layover nor in shadow."""
    i = local_incidence(slope_deg, aspect_deg, incidence_deg, heading_deg)
    return (i > 0) & (i < 90)


def range_slope_mask(heights: DataFrame, incidence_deg: float, spacing_m: float) -> DataFrame:
    """``ok``: rows of heights ``v`` in order of range whose slope towards or away from the sensor gives no layover or shadow."""
    w = W.partitionBy("scene_id", "row").orderBy("col")
    rise = (F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v"))) / (spacing_m * (F.coalesce(F.lead("col").over(w), F.col("col")) - F.coalesce(F.lag("col").over(w), F.col("col"))))
    slope = F.degrees(F.atan(rise))
    return heights.withColumn("ok", (slope < incidence_deg) & (slope > incidence_deg - 90))


def displacement_curvature(shifts: DataFrame, cell: float = 1.0) -> DataFrame:
    """``curvature``: the greater of the second differences of the displacement's magnitude along and across; null at the border."""
    along, down = W.partitionBy("scene_id", "row").orderBy("col"), W.partitionBy("scene_id", "col").orderBy("row")
    s = shifts.withColumn("_m", F.hypot("dx", "dy"))
    second = lambda w: F.abs((F.lead("_m").over(w) - 2 * F.col("_m") + F.lag("_m").over(w)) / cell**2)
    s = s.withColumn("_a", second(along)).withColumn("_b", second(down))
    return s.select("scene_id", "row", "col", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b")).alias("curvature"))


def preprocessed(dn: DataFrame, kind: str = "sigma0", method: str = "lee", k: int = 5) -> DataFrame:
    """Calibrated and despeckled backscatter in decibels, from digital numbers ``v``."""
    power = dn.withColumn("v", rd.calibrated(F.col("v"), kind, db=False))
    return raster.despeckle(power, method, k=k).withColumn("db", 10 * F.log10(F.greatest(F.col("out"), F.lit(1e-10)))).select("scene_id", "row", "col", "db")


def flood_mapped(dn: DataFrame, threshold: float = -15.0, method: str = "lee", k: int = 5) -> DataFrame:
    """``preprocessed`` with ``flood``."""
    return preprocessed(dn, "sigma0", method, k).withColumn("flood", rd.flooded(F.col("db"), threshold))


def coherence_loss(pairs: DataFrame, least: float = 0.3, k: int = 7) -> DataFrame:
    """(scene_id, percent): the share of pixels whose windowed coherence is below ``least``."""
    c = detect.coherence(pairs, k)
    return c.groupBy("scene_id").agg((100.0 * F.count(F.when(F.col("coherence") < least, 1)) / F.count("coherence")).alias("percent"))


def debursted(lines: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """Lines (by, burst, line, ...) that their burst keeps (keep_from, keep_to), with ``row``: numbered through from 0."""
    kept = lines.join(ranges.select(by, "burst", "start", "keep_from", "keep_to"), [by, "burst"]).filter("line >= keep_from AND line < keep_to")
    size = ranges.withColumn("_ahead", F.sum(F.col("keep_to") - F.col("keep_from")).over(W.partitionBy(by).orderBy("start").rowsBetween(W.unboundedPreceding, -1))).select(by, "burst", F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    return kept.join(size, [by, "burst"]).withColumn("row", F.col("_ahead") + F.col("line") - F.col("keep_from")).drop("start", "keep_from", "keep_to", "_ahead")
