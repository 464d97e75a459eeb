"""The domain's tables, derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.raster import tiles_to_pixels

WIDTH = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene catalog from the events: provider, track, time, cloud cover, instrument, a box around a point of the id."""
    e = read(spark, sf_dir, "events")
    at = F.col("event_id")
    lon, lat = (at % 360 - 180).cast("double"), (at % 170 - 85).cast("double")
    of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    radar = lambda c: F.when(at % 4 == 0, c)
    return e.select(
        at.cast("string").alias("id"), F.col("event_type").alias("provider"), F.col("user_id").alias("track"), F.col("ts").alias("datetime"),
        F.least("value", F.lit(100.0)).alias("cloud_cover"), of("L1C", "L2A", "L2SP").alias("processing_level"),
        of("Sentinel-1A", "Sentinel-2B", "Landsat-8", None).alias("satellite"), of("C-SAR", "MSI", "OLI-TIRS", None).alias("sensor"),
        radar(F.when(at % 8 == 0, "GRD").otherwise("SLC")).alias("product_type"), radar(F.when(at % 16 < 8, "VV").otherwise("VV+VH")).alias("polarisation"),
        radar(F.when(at % 5 < 2, "ascending").otherwise("descending")).alias("pass_direction"), F.concat("event_type", F.lit("-"), (at % 2 + 1).cast("string")).alias("collection"),
        (at % 6 * 10 + 10).cast("double").alias("resolution_m"),
        lon.alias("min_lon"), lat.alias("min_lat"), (lon + 1).alias("max_lon"), (lat + 1).alias("max_lat"), F.col("props").alias("properties"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", (key % 170 - 85).cast("double").alias("lat"), (key % 360 - 180).cast("double").alias("lon"), "c_acctbal")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    dn, red, nir = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("date"), (red * 0.9 + 0.01).alias("blue"), (F.col("l_quantity") / 50).alias("green"),
        red.alias("red"), nir.alias("nir"), (dn / 1e5).alias("swir1"), (dn / 2e5 + nir).alias("swir2"), (dn / 3e5 + 0.01).alias("swir3"), (nir * 0.5 + 0.05).alias("swir4"),
        (red * 0.5 + 0.02).alias("swir5"), (nir * 0.8 + 0.01).alias("nir1"), ((red + nir) / 2 + 0.005).alias("red_edge"), dn.alias("dn"),
    )


def raster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, row, col, a, b): each even raster with the next one."""
    p = rasters(spark, sf_dir)
    b = p.select((F.col("scene_id") - 1).alias("scene_id"), "row", "col", F.col("v").alias("b"))
    return p.filter("scene_id % 2 = 0").withColumnRenamed("v", "a").join(b, ["scene_id", "row", "col"])


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_to_pixels(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH)


def track_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("ts").cast("date").alias("date")).distinct()


#: Rows of a partition whose pixels are solved.
ROWS = 500_000


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel, day, p, c): mean price and discount of each part's shipment days, as a pixel's level and coherence.

    A pixel's rows are dealt once, over a number of partitions that grows with the table; what is done by pixel leaves them there.
    """
    lines = read(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // ROWS))
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = lines.select(F.col("l_partkey").alias("pixel"), day.alias("day"), "l_extendedprice", "l_discount").repartition(parts, "pixel")
    return rows.groupBy("pixel", "day").agg((F.avg("l_extendedprice") / 1e5).alias("p"), F.avg("l_discount").alias("c"))


def interferograms(spark: SparkSession, sf_dir: str, reach: int = 3) -> DataFrame:
    """Pairs of each pixel's dates with the next ``reach`` ones: redundant networks of phases that close."""
    w = W.partitionBy("pixel").orderBy("day")
    later = F.array(*[F.struct(F.lead("day", i).over(w).alias("d2"), F.lead("p", i).over(w).alias("q"), F.lit(i).alias("apart")) for i in range(1, reach + 1)])
    d = levels(spark, sf_dir).withColumn("x", later).select("pixel", F.col("day").alias("d1"), "p", "c", F.explode("x").alias("x")).filter("x.d2 IS NOT NULL")
    return d.select("pixel", "d1", "x.d2", (F.col("x.q") - F.col("p")).alias("phase"), (0.3 + F.col("c") * 5 / F.col("x.apart")).alias("coherence"))
