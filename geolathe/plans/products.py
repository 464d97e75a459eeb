"""Queries of annotation files, written by Spark from the given tables and taken apart again, and of orbits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, orbits
from ..sources import products
from ..sources import tables as t
from .base import SCENES, add, r6, sr

_c = F.col


def _files(s, d):
    """An orbit file a hundred orders, as text."""
    o = t.read(s, d, "orders").select((_c("o_orderkey") % 100).alias("k"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "o_totalprice", "o_custkey")
    osv = F.concat(F.lit("<OSV><UTC>UTC="), "at", F.lit("</UTC><X>"), _c("o_totalprice").cast("string"), F.lit("</X><Y>"), _c("o_custkey").cast("string"), F.lit("</Y><Z>1.5</Z><VX>0</VX><VY>-2</VY><VZ>3</VZ></OSV>"))
    rows = o.select("k", "o_orderkey", osv.alias("x")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "x"))).alias("a"))
    return rows.select(_c("k").cast("string").alias("file"), F.concat(F.lit("<Earth_Explorer_File><List_of_OSVs>"), F.array_join(F.transform("a", lambda r: r.x), ""), F.lit("</List_of_OSVs></Earth_Explorer_File>")).alias("content"))


add("orbit_vectors_parsed", "SELECT CAST(o_orderkey % 100 AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) - 1 AS INT) AS number, date_trunc('second', o_orderdate) AS time, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, -2.0::DOUBLE AS vy FROM orders")(
    lambda s, d: products.orbit_vectors(_files(s, d)).select("file", "number", "time", "x", "y", "vy")
)
# positions that are polynomials of the fourth degree, which the formula gives exactly
_POLY = "1000.0 + 3.0 * t - 0.5 * t * t + 0.02 * t * t * t - 0.001 * t * t * t * t"
add("orbit_interpolation", "SELECT p_partkey AS id, round(1000.0 + 3.0 * u - 0.5 * u * u + 0.02 * u * u * u - 0.001 * u * u * u * u, 4) AS x FROM (SELECT p_partkey, p_size * 0.37 AS u FROM part)")(
    lambda s, d: orbits.interpolated(
        t.read(s, d, "part").select((_c("p_partkey") % 4).alias("k"), F.floor(_c("p_partkey") / 4).alias("n")).filter("n < 25").select("k", (_c("n") * 1.0).alias("t")).distinct().withColumn("x", F.expr(_POLY)),
        t.read(s, d, "part").select(_c("p_partkey").alias("id"), (_c("p_partkey") % 4).alias("k"), (_c("p_size") * 0.37).alias("t")), "k", "t", ["x"], "id",
    ).select("id", F.round("x", 4).alias("x"))
)
# a table that is linear along lines and pixels
add("calibration_table_values", "SELECT p_partkey AS id, round(10 + 2.0 * least(900, p_partkey % 1100) + 0.5 * least(4000, p_size * 97 % 5000), 6) + 0.0 AS value FROM part")(
    lambda s, d: orbits.table_values(
        s.range(10).select(F.lit(1).alias("k"), (_c("id") * 100).cast("long").alias("line")).crossJoin(s.range(9).select((_c("id") * 500).cast("long").alias("pixel"))).withColumn("value", 10 + 2.0 * _c("line") + 0.5 * _c("pixel")),
        t.read(s, d, "part").select(_c("p_partkey").alias("id"), F.lit(1).alias("k"), (_c("p_partkey") % 1100).alias("line"), (_c("p_size") * 97 % 5000).cast("long").alias("pixel")), "k", "id",
    ).select("id", r6(_c("value")).alias("value"))
)
add("provider_capabilities", f"SELECT provider, count(*) AS n_scenes, bool_or(polarisation IS NOT NULL) AS sar, bool_or(sensor IS NOT NULL AND polarisation IS NULL) AS optical, string_agg(DISTINCT processing_level, ' ' ORDER BY processing_level) AS levels, min(resolution_m) AS finest_m FROM {SCENES} GROUP BY provider")(
    lambda s, d: catalog.capabilities(t.scenes(s, d)).select("provider", "n_scenes", "sar", "optical", F.array_join("levels", " ").alias("levels"), "finest_m")
)
add("providers_with_capability", f"SELECT provider FROM {SCENES} GROUP BY provider HAVING bool_or(polarisation IS NOT NULL) AND bool_or(processing_level = 'L2A')")(lambda s, d: catalog.with_capability(catalog.capabilities(t.scenes(s, d)), sar=True, level="L2A").select("provider"))
