"""Detectors and measures over pixel tables (scene_id, row, col, v); rasters are mirrored at the border of a box."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stencil as st
from .raster import KEY, _line

LEVELS = 64
#: Rows of a partition that clusters are trained on.
ROWS = 500_000
#: Distances to the neighbours in row-major order.
STEPS = (2**0.5, 1.0, 2**0.5, 1.0, 1.0, 2**0.5, 1.0, 2**0.5)


def bright_targets(pixels: DataFrame, guard: int = 5, background: int = 21, factor: float = 3.0) -> DataFrame:
    """``target``: whether a pixel exceeds the mean of the ring between two boxes by ``factor`` deviations; null without a ring."""
    halo = background // 2

    def run(x: dict) -> dict:
        v = x["v"]
        n, s, q = (st.box_sum(a, background) - st.box_sum(st.core(a, halo - guard // 2), guard) for a in ((~np.isnan(v)).astype(float), v, v * v))
        mean = s / n
        return {"ring_mean": mean, "ring_std": np.sqrt(np.maximum(0.0, q / n - mean * mean))}

    p = st.stencil(pixels, halo, run, ["ring_mean", "ring_std"])
    return p.withColumn("target", F.col("v") > F.col("ring_mean") + factor * F.col("ring_std"))


def texture(pixels: DataFrame, k: int = 5) -> DataFrame:
    """contrast, dissimilarity, homogeneity and asm of values cut into LEVELS between a scene's extremes.

    A pixel's partner is its left neighbour; the first column's is the last one.
    """
    ends = pixels.groupBy(*KEY).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    q = pixels.join(ends, list(KEY)).withColumn("q", F.floor((LEVELS - 1) * F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0.0))).cast("double"))
    line = _line("row", "col")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    q = q.withColumn("d", F.col("q") - F.coalesce(F.lag("q").over(line), F.last("q").over(whole)))

    def run(x: dict) -> dict:
        d = x["d"]
        return {"contrast": st.box_mean(d * d, k), "dissimilarity": st.box_mean(np.abs(d), k), "homogeneity": st.box_mean(1 / (1 + d * d), k), "asm": 1 / (1 + st.moments(x["q"], k)[1])}

    out = ["contrast", "dissimilarity", "homogeneity", "asm"]
    return st.stencil(q, k // 2, run, out, ["q", "d"]).select("scene_id", "row", "col", *out)


def flow_direction(pixels: DataFrame) -> DataFrame:
    """``direction``: 0 to 7 for the neighbour of the steepest descent in row-major order, the first of equals; -1 for a sink."""

    def run(x: dict) -> dict:
        drop = (st.core(x["v"], 1) - st.neighbours(x["v"])) / np.array(STEPS)[:, None, None, None]
        drop = np.where(np.isnan(drop), -np.inf, drop)
        return {"direction": np.where(drop.max(0) > 0, drop.argmax(0), -1).astype(float)}

    p = st.stencil(pixels, 1, run, ["direction"], border="none")
    return p.select("scene_id", "row", "col", F.col("direction").cast("int").alias("direction"))


def subtract_dark(pixels: DataFrame, by: Sequence[str] = KEY, share: float = 0.01, scale: float = 1.0) -> DataFrame:
    """Values above zero less the given percentile of such values of their scene, by ``scale``; others become zero."""
    dark = pixels.filter("v > 0").groupBy(*by).agg(F.percentile("v", F.lit(share)).alias("_dark"))
    return pixels.join(dark, list(by), "left").withColumn("out", F.when(F.col("v") > 0, (F.col("v") - F.col("_dark")) * scale).otherwise(0.0)).drop("_dark")


def median_3x3(pixels: DataFrame) -> DataFrame:
    """Median of the known values in the 3 x 3 box, whose border pixels repeat; a null pixel stays null."""

    def run(x: dict) -> dict:
        here = st.core(x["v"], 1)
        return {"out": np.where(np.isnan(here), np.nan, np.nanmedian(np.concatenate((st.neighbours(x["v"]), here[None])), 0))}

    return st.stencil(pixels, 1, run, ["out"], border="edge").select("scene_id", "row", "col", "out")


def coherence(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Magnitude of the windowed complex correlation of (re1, im1) and (re2, im2), at most 1; the raster is mirrored at its border."""

    def run(x: dict) -> dict:
        a, b = x["re1"] + 1j * x["im1"], x["re2"] + 1j * x["im2"]
        cross = a * np.conj(b)
        box = lambda z: st.box_sum(z, k)
        power = np.sqrt(box(np.abs(a) ** 2) * box(np.abs(b) ** 2))
        return {"coherence": np.minimum(1.0, np.hypot(box(cross.real), box(cross.imag)) / np.where(power > 0, power, np.nan))}

    return st.stencil(pairs, k // 2, run, ["coherence"], ["re1", "im1", "re2", "im2"]).select("scene_id", "row", "col", "coherence")


def strain(shifts: DataFrame, cell: float = 1.0) -> DataFrame:
    """exx, eyy, exy by central differences of (dx, dy); null at the border and beside a missing shift."""
    along, down = _line("row", "col"), _line("col", "row")
    slope = lambda c, w: (F.lead(c).over(w) - F.lag(c).over(w)) / (2 * cell)
    s = shifts.withColumn("exx", slope("dx", along)).withColumn("_xy", slope("dx", down)).withColumn("eyy", slope("dy", down)).withColumn("_yx", slope("dy", along))
    return s.select("scene_id", "row", "col", "exx", "eyy", ((F.col("_xy") + F.col("_yx")) / 2).alias("exy"))


def structure_function(pixels: DataFrame, lags: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """(lag, rms, n) of differences along rows, over all pixels."""
    line = _line("row", "col")
    apart = F.array(*[F.struct(F.lit(n).alias("lag"), (F.col("v") - F.lag("v", n).over(line)).alias("d")) for n in lags])
    found = pixels.select(apart.alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return found.filter("d IS NOT NULL").groupBy("lag").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.count("*").alias("n"))


def kmeans(pixels: DataFrame, features: Sequence[str], clusters: int = 5, seed: int = 42) -> DataFrame:
    """``cluster`` of each row; -1 where a feature is missing.

    Training holds its rows as objects, a partition in one block, so many rows are dealt by their values over partitions of
    about ROWS and put in order there; rows get their cluster where they lie.
    """
    known = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep")
    ok = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in features)
    good = pixels.filter(ok)
    rows, train = good.count(), good
    if rows > ROWS:
        parts = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
        train = good.repartition(parts, *good.columns).select(*features).sortWithinPartitions(*features)
    model = KMeans(k=clusters, seed=seed, featuresCol="_f", predictionCol="cluster").fit(known.transform(train))
    return model.transform(known.transform(good)).drop("_f").unionByName(pixels.filter(f"NOT ({ok})").withColumn("cluster", F.lit(-1)))
