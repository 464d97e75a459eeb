"""Ionosphere maps: files of blocks of text as a table of nodes, and back.

Readers take (file, content) rows, which ``products.read_files`` gives. A file without a header's end or maps gives no rows;
the value 9999 stands for none; a header without an exponent has -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"-?\d+(?:\.\d+)?"


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda x: x.try_cast("double"))


def _labelled(text: Column, label: str) -> Column:
    """The numbers ahead of a label on its line."""
    return _numbers(F.regexp_extract(text, rf"(?m)^([^\n]*?){label}", 1))


def vtec_maps(files: DataFrame) -> DataFrame:
    """(file, time, i, j, lat, lon, vtec): a row a node of each map of total electron content, i and j its row and column."""
    head = F.substring_index("content", "END OF HEADER", 1)
    f = files.filter(F.contains("content", F.lit("END OF HEADER"))).select("file", F.substr("content", F.length(head) + 1).alias("_body"), F.coalesce(F.try_element_at(_labelled(head, "EXPONENT"), F.lit(1)), F.lit(-1.0)).alias("_exp"))
    f = f.select("file", "_exp", F.explode(F.slice(F.split("_body", "START OF TEC MAP"), F.lit(2), F.lit(1 << 20))).alias("_map")).withColumn("_map", F.substring_index("_map", "END OF TEC MAP", 1))
    at = _labelled(F.col("_map"), "EPOCH OF CURRENT MAP")
    f = f.withColumn("_t", at).filter(F.size("_t") >= 6)
    part = lambda i: F.element_at("_t", i).cast("int")
    day = F.make_date(part(1), part(2), part(3)).cast("timestamp_ntz")
    f = f.withColumn("time", day + F.make_dt_interval(F.lit(0), part(4), part(5), F.element_at("_t", 6)))  # an hour of 24 is the next day's
    # each row of a map: its own line, and the lines of values that follow
    rows = F.arrays_zip(F.regexp_extract_all("_map", F.lit(r"([^\n]*)LAT/LON1/LON2/DLON/H"), F.lit(1)).alias("line"), F.regexp_extract_all("_map", F.lit(r"LAT/LON1/LON2/DLON/H[^\n]*\n((?:[ \t]*-?\d[ \t\d-]*\r?\n?)*)"), F.lit(1)).alias("values"))
    f = f.select("file", "time", "_exp", F.posexplode(rows).alias("i", "_r")).select("file", "time", "_exp", "i", _numbers(F.col("_r.line")).alias("_l"), F.posexplode(_numbers(F.col("_r.values"))).alias("j", "_v"))
    lon = F.element_at("_l", 2) + F.col("j") * F.element_at("_l", 4)
    within = F.col("j") <= F.rint((F.element_at("_l", 3) - F.element_at("_l", 2)) / F.element_at("_l", 4))
    vtec = F.when(F.col("_v") != 9999, F.col("_v") * F.pow(F.lit(10.0), F.col("_exp")))
    return f.filter(F.size("_l") >= 4).filter(within).select("file", "time", "i", "j", F.element_at("_l", 1).alias("lat"), lon.alias("lon"), vtec.alias("vtec"))


def as_files(maps: DataFrame, file: str = "file") -> DataFrame:
    """(file, content) of maps (file, time, i, j, lat, lon, vtec on a regular grid), sixteen values a line, in tenths. Rows of one file are gathered: one day's maps."""
    fixed = lambda c, n: F.lpad(F.format_string("%.1f", c), n, " ")
    whole = lambda c, n: F.lpad(c.cast("string"), n, " ")
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("_v") - 1) / 16).cast("int")), lambda k: F.array_join(F.slice("_v", k * 16 + 1, F.lit(16)), ""))
    value = whole(F.coalesce(F.rint(F.col("vtec") * 10).cast("int"), F.lit(9999)), 5)
    rows = maps.groupBy(file, "time", "i", "lat").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", value.alias("v")))), lambda x: x["v"]).alias("_v"), F.min("lon").alias("_a"), F.max("lon").alias("_b"))
    step = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.size("_v") - 1), F.lit(0.0))
    head = F.concat(F.lit("  "), *[fixed(c, 6) for c in (F.col("lat"), F.col("_a"), F.col("_b"), step, F.lit(450.0))], F.lit(" " * 28), F.lit("LAT/LON1/LON2/DLON/H\n"))
    rows = rows.withColumn("_text", F.concat(head, F.array_join(lines, "\n"), F.lit("\n")))
    epoch = F.concat(*[whole(F.date_part(F.lit(p), F.col("time")).cast("int"), 6) for p in ("year", "month", "day", "hour", "minute", "second")])
    by_map = rows.groupBy(file, "time").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "_text"))), lambda x: x["_text"]), "").alias("_text"))
    text = F.concat(F.lit("     1" + " " * 54 + "START OF TEC MAP\n"), epoch, F.lit(" " * 24 + "EPOCH OF CURRENT MAP\n"), F.col("_text"), F.lit("     1" + " " * 54 + "END OF TEC MAP\n"))
    whole_file = by_map.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", text.alias("x")))), lambda m: m["x"]), "").alias("_maps"))
    header = "     1.0            IONOSPHERE MAPS     GPS                 IONEX VERSION / TYPE\n" + f"{-1:6d}" + " " * 54 + "EXPONENT\n" + " " * 60 + "END OF HEADER\n"
    return whole_file.select(F.col(file).alias("file"), F.concat(F.lit(header), F.col("_maps"), F.lit(" " * 60 + "END OF FILE\n")).alias("content"))
