"""Electron content between the nodes and times of ionosphere maps, and the phase that it makes in a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import ionosphere_phase, pierce_point


def map_cells(maps: DataFrame) -> DataFrame:
    """(time, i, j, lat, lon, d_lat, d_lon, v00, v01, v10, v11, last_i, last_j): each cell between four nodes of a map.

    Maps of one time (files share midnight) count once, the first file's.
    """
    first = maps.groupBy("time").agg(F.min("file").alias("_f"))
    m = maps.join(first, "time").filter(F.col("file") == F.col("_f"))
    east, south = W.partitionBy("time", "i").orderBy("j"), W.partitionBy("time", "j").orderBy("i")
    m = m.withColumns({"v01": F.lead("vtec").over(east), "_lon": F.lead("lon").over(east)}).withColumns({"v10": F.lead("vtec").over(south), "v11": F.lead("v01").over(south), "_lat": F.lead("lat").over(south)})
    m = m.filter("_lon IS NOT NULL AND _lat IS NOT NULL")
    return m.select("time", "i", "j", "lat", "lon", (F.col("_lat") - F.col("lat")).alias("d_lat"), (F.col("_lon") - F.col("lon")).alias("d_lon"), F.col("vtec").alias("v00"), "v01", "v10", "v11")


def map_times(cells: DataFrame) -> DataFrame:
    """(day, times): for each day the maps of that day and the ones beside it, with the grid of each; a few dozen a day."""
    grid = F.struct("time", "lat0", "lon0", "d_lat", "d_lon", "last_i", "last_j")
    t = cells.groupBy("time").agg(F.min_by("lat", F.struct("i", "j")).alias("lat0"), F.min_by("lon", F.struct("i", "j")).alias("lon0"), F.first("d_lat").alias("d_lat"), F.first("d_lon").alias("d_lon"), F.max("i").alias("last_i"), F.max("j").alias("last_j"))
    t = t.select(F.explode(F.array(*[F.date_add(F.to_date("time"), k) for k in (-1, 0, 1)])).alias("day"), grid.alias("_g"))
    return t.groupBy("day").agg(F.array_sort(F.collect_list("_g")).alias("times"))


def _looked_up(targets: DataFrame, cells: DataFrame, grid: str, lat: Column, lon: Column, out: str) -> DataFrame:
    """``targets`` with ``out``: bilinear in the cell of the map that the struct ``grid`` names; beyond its edge the outermost cell goes on."""
    g = F.col(grid)
    place = lambda x, x0, d, last: F.greatest(F.lit(0), F.least(F.floor(F.try_divide(x - x0, d)).cast("int"), last))
    t = targets.withColumns({"_i": place(lat, g["lat0"], g["d_lat"], g["last_i"]), "_j": place(lon, g["lon0"], g["d_lon"], g["last_j"]), "_t": g["time"]})
    c = cells.select(F.col("time").alias("_ct"), F.col("i").alias("_ci"), F.col("j").alias("_cj"), F.struct("lat", "lon", "d_lat", "d_lon", "v00", "v01", "v10", "v11").alias("_c"))
    t = t.join(c, (F.col("_t") == F.col("_ct")) & (F.col("_i") == F.col("_ci")) & (F.col("_j") == F.col("_cj")), "left")
    u, w = (lat - F.col("_c.lat")) / F.col("_c.d_lat"), (lon - F.col("_c.lon")) / F.col("_c.d_lon")
    term = lambda v, share: F.when(share == 0, F.lit(0.0)).otherwise(F.col(f"_c.{v}") * share)  # noqa: E731  a node without weight may be without a value
    value = term("v00", (1 - u) * (1 - w)) + term("v01", (1 - u) * w) + term("v10", u * (1 - w)) + term("v11", u * w)
    return t.withColumn(out, value).drop("_i", "_j", "_t", "_ct", "_ci", "_cj", "_c")


def vtec_at(targets: DataFrame, maps: DataFrame, time: str, lat: str, lon: str, out: str = "vtec", turning: bool = False) -> DataFrame:
    """``targets`` with ``out``, the vertical electron content at their time and place.

    From the map nearest in time, the earlier of equals; or, ``turning``, linear in time between the two maps around it, each
    looked up where the sun was then, so that the maps turn with it. Null where there is no map within about a day, none on
    either side if ``turning``, or a node around it has no value. Equality joins on the day and on the cell; a row stays one row.
    """
    cells = map_cells(maps)
    days = map_times(cells)
    t = targets.join(days.withColumnRenamed("day", "_day"), F.to_date(time) == F.col("_day"), "left")
    second = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    now = second(F.col(time))
    place = F.col(lat)
    if not turning:
        # structs compare field by field: the distance, then the time
        near = F.array_min(F.transform("times", lambda g: F.struct(F.abs(second(g["time"]) - now).alias("far"), g.alias("g"))))["g"]
        t = t.withColumn("_g", near)
        return _looked_up(t, cells, "_g", place, F.col(lon), out).select(*targets.columns, out)
    t = t.withColumn("_g", F.array_max(F.filter("times", lambda g: g["time"] <= F.col(time)))).withColumn("_h", F.array_min(F.filter("times", lambda g: g["time"] >= F.col(time))))
    turned = lambda g: F.pmod(F.col(lon) + (now - second(F.col(g)["time"])) / 240 + 180, F.lit(360.0)) - 180
    t = _looked_up(_looked_up(t, cells, "_g", place, turned("_g"), "_v0"), cells, "_h", place, turned("_h"), "_v1")
    share = F.coalesce(F.try_divide(now - second(F.col("_g.time")), second(F.col("_h.time")) - second(F.col("_g.time"))), F.lit(0.0))
    return t.select(*targets.columns, (F.col("_v0") * (1 - share) + F.col("_v1") * share).alias(out))


def pair_phase(pixels: DataFrame, maps: DataFrame, turning: bool = False, shell_km: float = 450.0) -> DataFrame:
    """``pixels`` with ``ionosphere``, the phase to take from a pair's: of the secondary less that of the reference.

    Pixels have lat, lon, and for each of ref and sec a time, azimuth and elevation of the satellite (ref_time, ref_azimuth, ...).
    Each pixel's line of sight crosses the shell at its own place, and takes the maps' content there.
    """
    out = pixels
    for side in ("ref", "sec"):
        p = pierce_point(F.col("lat"), F.col("lon"), F.col(f"{side}_azimuth"), F.col(f"{side}_elevation"), shell_km)
        out = vtec_at(out.withColumns({"_plat": p["ipp_lat"], "_plon": p["ipp_lon"]}), maps, f"{side}_time", "_plat", "_plon", f"_{side}", turning).drop("_plat", "_plon")
    made = lambda side: ionosphere_phase(F.col(f"_{side}"), 90 - F.col(f"{side}_elevation"), shell_km=shell_km)
    return out.withColumn("ionosphere", made("sec") - made("ref")).drop("_ref", "_sec")
