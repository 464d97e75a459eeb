"""A catalog source over STAC item files: JSON lines or documents, read with a fixed schema and flattened to scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, collection string, bbox array<double>, geometry struct<type:string>, properties map<string,string>, assets map<string,struct<href:string,type:string>>"


def read_items(spark: SparkSession, path: str, provider: str, multiline: bool = False) -> DataFrame:
    p = lambda *names: F.coalesce(*[F.try_element_at("properties", F.lit(n)) for n in names])
    items = spark.read.schema(ITEM).option("multiLine", multiline).json(path)
    return items.select(
        "id", F.lit(provider).alias("provider"), "collection", F.to_timestamp(p("datetime", "start_datetime")).cast("timestamp_ntz").alias("datetime"),
        p("eo:cloud_cover", "cloudCover").cast("double").alias("cloud_cover"), p("processing:level", "processingLevel", "processing_level").alias("processing_level"),
        *[F.try_element_at("bbox", F.lit(i)).alias(n) for i, n in ((1, "min_lon"), (2, "min_lat"), (3, "max_lon"), (4, "max_lat"))], "assets",
    )


def write_scenes(scenes: DataFrame, path: str, by: tuple[str, ...] = ("provider",)) -> None:
    """Parquet by provider, so that searches of one provider read its files alone."""
    scenes.write.partitionBy(*by).parquet(path)
