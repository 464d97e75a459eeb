"""Flow over elevation rasters: direction, accumulation, wetness, drainage and depressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detect
from . import stencil as st
from .raster import gradient

CELL = ["scene_id", "row", "col"]


def accumulation(pixels: DataFrame, rounds: int = 64) -> DataFrame:
    """``acc``: the cells that drain through each one, itself included.

    Paths are doubled: after k rounds a cell knows those within 2^k steps above it and where it leads in 2^k steps,
    so a raster of any size takes a logarithm of its longest path. Each round is one join and one sum.
    """
    d = detect.flow_direction(pixels)
    at = F.col("direction")
    step = lambda i: F.element_at(F.array(*[F.lit(i(n)) for n in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))]), at + 1)
    to = [F.when(at >= 0, F.col(c) + step(lambda n, i=i: n[i])).alias(f"to_{c}") for i, c in enumerate(("row", "col"))]
    state = _kept(d.select(*CELL, F.lit(1).cast("long").alias("acc"), *to))
    for _ in range(rounds):
        if not state.filter("to_row IS NOT NULL").limit(1).count():
            return state.select(*CELL, "acc")
        given = state.filter("to_row IS NOT NULL").groupBy("scene_id", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("acc").alias("more"))
        ahead = state.select("scene_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("next_row"), F.col("to_col").alias("next_col"))
        state = state.join(given, CELL, "left").join(ahead, ["scene_id", "to_row", "to_col"], "left")
        state = _kept(state.select(*CELL, (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"), F.col("next_row").alias("to_row"), F.col("next_col").alias("to_col")))
    raise RuntimeError("the flow does not end")


def _kept(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: in the checkpoint folder where there is one, else as it is, cached."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def wetness(pixels: DataFrame, cell: float = 1.0) -> DataFrame:
    """``twi``: the logarithm of the area above a cell a unit of width over its slope, of 0.1 degrees at least."""
    slope = F.atan(F.sqrt(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy")))
    g = gradient(pixels, cell=cell).select(*CELL, F.greatest(slope, F.radians(F.lit(0.1))).alias("slope"))
    return accumulation(pixels).join(g, CELL).select(*CELL, F.log(F.col("acc") * cell / F.tan("slope")).alias("twi"))


def drainage(acc: DataFrame, threshold: int | None = None, share: float = 0.99) -> DataFrame:
    """``acc`` with ``stream``: cells of at least ``threshold``, or of their raster's given percentile."""
    if threshold is not None:
        return acc.withColumn("stream", F.col("acc") >= threshold)
    least = acc.groupBy("scene_id").agg(F.percentile("acc", F.lit(share)).alias("_least"))
    return acc.join(least, "scene_id").withColumn("stream", F.col("acc") >= F.col("_least")).drop("_least")


def depressions(pixels: DataFrame, least: float = 0.1, rounds: int = 1000) -> DataFrame:
    """``filled``: the level to which water stands, and ``depth`` of at least ``least``.

    The level of a cell is the lowest one over all ways to the border of the highest cell on the way. Tiles are
    settled each in itself, with their neighbours' last levels around them, until no level changes.
    """
    ends = st.extents(pixels)
    rim = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    state = _kept(pixels.join(ends, "scene_id").select(*CELL, "v", F.when(rim, F.col("v")).otherwise(F.lit(1e300)).alias("f")))

    def settle(x: dict) -> dict:
        level, ground = x["f"].copy(), st.core(x["v"], 1)
        while True:
            low = np.minimum(st.core(level, 1), np.maximum(ground, np.nanmin(st.neighbours(level), 0)))
            if not (low < st.core(level, 1)).any():
                return {"g": low}
            level[:, 1:-1, 1:-1] = low

    for _ in range(rounds):
        last, state = state, _kept(st.stencil(state, 1, settle, ["g"], ["v", "f"], border="none").select(*CELL, "v", F.col("g").alias("f")))
        if not state.join(last.select(*CELL, F.col("f").alias("_f")), CELL).filter("f < _f").limit(1).count():
            return state.select(*CELL, F.col("f").alias("filled"), F.when(F.col("f") - F.col("v") >= least, F.col("f") - F.col("v")).otherwise(0.0).alias("depth"))
    raise RuntimeError("levels did not settle")


def regions(pixels: DataFrame, least_area: int = 1, rounds: int = 1000) -> DataFrame:
    """(scene_id, row, col, value, region, area) of 4-connected cells of one whole value, of at least so many cells; a
    region is named by its first cell in row-major order.

    Tiles are labelled each in itself, with their neighbours' last labels around them, until no label changes.
    """
    state = _kept(pixels.filter("v IS NOT NULL").select(*CELL, F.col("v").cast("long").cast("double").alias("v"), (F.col("row") * F.lit(2.0**26) + F.col("col")).alias("f")))

    def spread(x: dict) -> dict:
        value, label = x["v"], x["f"].copy()
        here = st.core(value, 1)
        same = [st.neighbours(value)[i] == here for i in (1, 3, 4, 6)]
        while True:
            near = st.neighbours(label)[[1, 3, 4, 6]]
            low = np.fmin(st.core(label, 1), np.nanmin(np.where(same, near, np.inf), 0))
            if not (low < st.core(label, 1)).any():
                return {"g": low}
            label[:, 1:-1, 1:-1] = low

    for _ in range(rounds):
        last, state = state, _kept(st.stencil(state, 1, spread, ["g"], ["v", "f"], border="none").select(*CELL, "v", F.col("g").alias("f")))
        if not state.join(last.select(*CELL, F.col("f").alias("_f")), CELL).filter("f < _f").limit(1).count():
            break
    else:
        raise RuntimeError("labels did not settle")
    area = state.groupBy("scene_id", "f").agg(F.count("*").alias("area")).filter(F.col("area") >= least_area)
    return state.join(area, ["scene_id", "f"]).select(*CELL, F.col("v").cast("long").alias("value"), F.col("f").cast("long").alias("region"), "area")
