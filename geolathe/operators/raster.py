"""Raster operators over pixel tables (scene_id, row, col, v): focal ones by tiles, differences as windows, stacks as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stencil as st
from .series import zone_percentiles

KEY = ("scene_id",)


def tiles_to_pixels(tiles: DataFrame, scene: str, data: str, width: int) -> DataFrame:
    p = tiles.select(F.col(scene).alias("scene_id"), F.posexplode(data).alias("_i", "v"))
    return p.select("scene_id", F.floor(F.col("_i") / width).cast("int").alias("row"), (F.col("_i") % width).cast("int").alias("col"), F.col("v").cast("double").alias("v"))


def _line(across: str, along: str):
    return W.partitionBy(*KEY, across).orderBy(along)


def focal_mean(pixels: DataFrame, k: int = 5, value: str = "v", out: str = "mean") -> DataFrame:
    """Mean of the known pixels in the k x k box; the raster is mirrored at its border."""
    return st.stencil(pixels, k // 2, lambda x: {out: st.box_mean(x[value], k)}, [out], [value])


def local_moments(pixels: DataFrame, k: int = 5, value: str = "v") -> DataFrame:
    """``m`` and ``var`` of the box."""
    return st.stencil(pixels, k // 2, lambda x: dict(zip(("m", "var"), st.moments(x[value], k))), ["m", "var"], [value])


def despeckle(pixels: DataFrame, method: str = "lee", looks: float = 1.0, k: int = 5, value: str = "v") -> DataFrame:
    """boxcar, lee, enhanced_lee, gamma or frost filter in ``out``; the raster is mirrored at its border."""
    e = 1e-10

    def run(arrays: dict) -> dict:
        x = st.core(arrays[value], k // 2)
        m, v = st.moments(arrays[value], k)
        noise = m * m / (looks + e)
        if method == "boxcar":
            out = m
        elif method == "lee":
            out = m + v / (v + noise + e) * (x - m)
        elif method == "enhanced_lee":
            cv, t = np.sqrt(v) / (m + e), 1 / (looks + e) ** 0.5
            w = np.where(cv <= t, 0.0, np.where(cv > 3 * t, 1.0, (cv - t) / (2 * t + e)))
            out = (1 - w) * m + w * x
        else:
            out = m + np.clip((v - noise) / (v + noise + e), 0, 1) * (x - m)
        return {"out": out}

    if method == "frost":
        return _frost(pixels, k, value)
    if method not in ("boxcar", "lee", "enhanced_lee", "gamma"):
        raise ValueError(f"unknown filter: {method}")
    return st.stencil(pixels, k // 2, run, ["out"], [value])


def _frost(pixels: DataFrame, k: int, value: str) -> DataFrame:
    """A blend of each pixel with a Gaussian whose width the scene's mean coefficient of variation sets."""
    e = 1e-10
    p = st.stencil(pixels, k // 2, lambda x: {"_cv": (lambda m, v: np.sqrt(v) / (m + e))(*st.moments(x[value], k))}, ["_cv"], [value])
    width = p.groupBy("scene_id").agg(F.greatest(k / (2 * (1 + F.avg("_cv")) + e), F.lit(0.1)).alias("_sigma"))
    halo = 2 * k + 1

    def run(arrays: dict) -> dict:
        x, cv = st.core(arrays[value], halo), st.core(arrays["_cv"], halo)
        # the width of a tile's scene, rounded so that equal ones go together
        sigma = np.round(np.nanmax(arrays["_sigma"], axis=(1, 2)), 9)
        smooth = np.empty_like(x)
        for one in np.unique(sigma):
            if not 0 < 4 * one + 0.5 < halo + 1:
                raise ValueError("the scene's mean variation is too far below zero")
            smooth[sigma == one] = st.gaussian(arrays[value][sigma == one], one, halo)
        alpha = np.exp(-cv * k)
        return {"out": alpha * x + (1 - alpha) * smooth}

    out = st.stencil(p.join(width, "scene_id"), halo, run, ["out"], [value, "_cv", "_sigma"])
    return out.drop("_cv", "_sigma")


def gradient(pixels: DataFrame, value: str = "v", cell: float = 1.0) -> DataFrame:
    """``zx`` along columns and ``zy`` along rows: central differences, one-sided at the border."""
    out = pixels
    for name, line in (("zx", _line("row", "col")), ("zy", _line("col", "row"))):
        before, after = F.lag(value).over(line), F.lead(value).over(line)
        out = out.withColumn(name, F.when(before.isNull(), (after - F.col(value)) / cell).when(after.isNull(), (F.col(value) - before) / cell).otherwise((after - before) / (2 * cell)))
    return out


def terrain(pixels: DataFrame, cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Slope and downhill aspect in degrees, and hillshade."""
    g = gradient(pixels, cell=cell)
    slope = F.atan(F.sqrt(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy")))
    aspect = F.pmod(F.degrees(F.atan2(-F.col("zx"), F.col("zy"))), F.lit(360.0))
    z, az = F.radians(F.lit(90 - altitude)), F.radians(F.lit(azimuth))
    shade = F.cos(z) * F.cos(slope) + F.sin(z) * F.sin(slope) * F.cos(az - F.radians(aspect))
    return g.select("scene_id", "row", "col", F.degrees(slope).alias("slope"), aspect.alias("aspect"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("hillshade"))


def ruggedness(pixels: DataFrame) -> DataFrame:
    """Root of the summed squared differences to the 8 neighbours; the outermost pixels stand beyond the border too."""

    def run(x: dict) -> dict:
        d = st.neighbours(x["v"]) - st.core(x["v"], 1)
        return {"tri": np.sqrt(np.nansum(d * d, 0))}

    return st.stencil(pixels, 1, run, ["tri"], border="edge").select("scene_id", "row", "col", "tri")


def curvature(pixels: DataFrame) -> DataFrame:
    gx = gradient(pixels).select("scene_id", "row", "col", "zx", "zy")
    xx = gradient(gx.select("scene_id", "row", "col", F.col("zx").alias("v"), "zy")).select("scene_id", "row", "col", F.col("zx").alias("zxx"), F.col("v"))
    yy = gradient(gx.select("scene_id", "row", "col", F.col("zy").alias("v"))).select("scene_id", "row", "col", F.col("zy").alias("zyy"))
    return xx.join(yy, ["scene_id", "row", "col"]).select("scene_id", "row", "col", (F.col("zxx") + F.col("zyy")).alias("curvature"))


def multilook(pixels: DataFrame, rows: int = 2, cols: int = 2) -> DataFrame:
    return pixels.groupBy("scene_id", F.floor(F.col("row") / rows).cast("int").alias("row"), F.floor(F.col("col") / cols).cast("int").alias("col")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def composite(pixels: DataFrame, by: Sequence[str], how: str, value: str = "v") -> DataFrame:
    """One value for each pixel of a stack: mean, median, min, max, first or last (by scene). A pixel has a value for each date, which the median holds."""
    pick = {
        "mean": F.avg(value), "median": F.median(value), "min": F.min(value), "max": F.max(value), "sum": F.sum(value),
        "first": F.min_by(value, "scene_id"), "last": F.max_by(value, "scene_id"),
    }[how]
    return pixels.filter(F.col(value).isNotNull()).groupBy(*by).agg(pick.alias(value))


def zonal_stats(pixels: DataFrame, zone: str, value: str = "v") -> DataFrame:
    """count, mean, median, min, max, std, sum and p90 of each zone; the percentiles by ranks, so that no task holds a zone."""
    v = F.col(value)
    base = pixels.groupBy(zone).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.sum(v).alias("sum"))
    q = zone_percentiles(pixels.select(zone, v.alias("v")), zone, (0.5, 0.9))
    q = q.groupBy(zone).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.5, "median"), (0.9, "p90"))])
    return base.join(q, zone, "left")


def trend(series: DataFrame, by: Sequence[str], date: str = "date", value: str = "v") -> DataFrame:
    """Slope a year; null with fewer than two values or one date only."""
    t = F.datediff(date, F.lit("1970-01-01").cast("date")) / 365.25
    return series.groupBy(*by).agg(F.when(F.count(value) >= 2, F.regr_slope(F.col(value), t)).alias("slope"), F.count(value).alias("n"))


def anomaly(series: DataFrame, by: Sequence[str], baseline: Column, target: Column, value: str = "v") -> DataFrame:
    v = F.col(value)
    s = series.groupBy(*by).agg(F.avg(F.when(target, v)).alias("x"), F.avg(F.when(baseline, v)).alias("m"), F.stddev_pop(F.when(baseline, v)).alias("s"))
    return s.select(*by, F.try_divide(F.col("x") - F.col("m"), F.nullif(F.col("s"), F.lit(0.0))).alias("z"))
