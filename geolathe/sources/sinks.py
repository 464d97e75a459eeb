"""Sinks of scenes: features and items as JSON lines, tables as CSV and Parquet, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import BOX


def geometry() -> Column:
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def stac_items(scenes: DataFrame) -> DataFrame:
    """(id, item): a catalog item of each scene as JSON."""
    properties = F.struct(
        F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover"), F.col("satellite").alias("platform"),
        F.array_compact(F.array("sensor")).alias("instruments"), F.col("processing_level").alias("processing:level"),
    )
    item = F.struct(F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), "id", "collection", F.array(*BOX).alias("bbox"), geometry().alias("geometry"), properties.alias("properties"))
    return scenes.select("id", F.to_json(item).alias("item"))


def features(scenes: DataFrame) -> DataFrame:
    """(id, feature): a GeoJSON feature of each scene; a file of them is a sequence of features, one a line."""
    return scenes.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry().alias("geometry"), F.struct("id", "provider", "datetime", "cloud_cover").alias("properties"))).alias("feature"))


def write(scenes: DataFrame, path: str, kind: str) -> None:
    """geojson and stac as JSON lines, csv with a header, or parquet by provider; all in parts, by the executors."""
    if kind == "geojson":
        features(scenes).select("feature").write.text(path)
    elif kind == "stac":
        stac_items(scenes).select("item").write.text(path)
    elif kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in scenes.dtypes]
        scenes.select(*flat).write.option("header", True).csv(path)
    elif kind == "parquet":
        scenes.write.partitionBy("provider").parquet(path)
    else:
        raise ValueError(f"unknown kind: {kind}")


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows there are and a hash that any order of them gives."""
    row = F.xxhash64(F.to_json(F.struct(*keys)))
    return df.agg(F.count("*").alias("n_rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("content_hash"))


def selected_points(selection: DataFrame, looks: tuple[int, int] = (1, 3), transform: tuple[float, ...] | None = None, geographic: bool = True) -> DataFrame:
    """(crop_row, crop_col, stack_row, stack_col, score, and lon, lat or x, y) of the picked pixels of (row, col, picked, score).

    Crop places are those of a pixel's centre at full resolution, ``looks`` pixels of it each way; map places need the six
    numbers of a ``transform`` of columns and rows, as for ``outlines.polygons``. Pixels whose ``picked`` is null are none.
    """
    y, x = F.col("row") + 0.5, F.col("col") + 0.5
    out = {"crop_row": y * looks[0], "crop_col": x * looks[1], "stack_row": F.col("row"), "stack_col": F.col("col"), "score": F.col("score")}
    if transform:
        a, b, c, d, e, f = transform
        names = ("lon", "lat") if geographic else ("x", "y")
        out |= {names[0]: a * x + b * y + c, names[1]: d * x + e * y + f}
    return selection.filter("picked").select(*[v.alias(k) for k, v in out.items()])


def export_points(selection: DataFrame, path: str, **how) -> None:
    """``selected_points`` as CSV with a header, in parts."""
    selected_points(selection, **how).write.option("header", True).csv(path)
