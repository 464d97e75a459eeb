"""Queries of ionosphere maps, written as files by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ionosphere
from ..sources import ionex
from ..sources import tables as t
from .base import add, r6, sr

_c = F.col


def _maps(s, d) -> DataFrame:
    """A file a thirty scenes, one map every two hours, of 13 x 13 nodes: content from the events of that hour."""
    e = t.read(s, d, "events").groupBy((_c("event_id") % 30).alias("day")).agg(F.count("*").alias("n"))
    times = e.select("day", "n", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    nodes = times.select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("j"))
    when = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(_c("day").cast("int"), (_c("k") * 2).cast("int"))
    return nodes.select(F.concat(F.lit("d"), _c("day").cast("string")).alias("file"), when.alias("time"), "i", "j", (60.0 - _c("i") * 10).alias("lat"), (_c("j") * 30.0 - 180).alias("lon"), ((_c("n") % 50 + _c("k") * 7 + _c("i") * _c("i") * 3 + _c("j") % 12 * 11) % 400 / 10.0).alias("vtec"))


def _read(s, d) -> DataFrame:
    return ionex.vtec_maps(ionex.as_files(_maps(s, d)))


_MAPS = """(SELECT 'd' || day AS file, TIMESTAMP '2024-01-01' + to_hours(CAST(day * 24 + k * 2 AS BIGINT)) AS time, CAST(i AS INT) AS i, CAST(j AS INT) AS j, 60.0::DOUBLE - i * 10 AS lat, j * 30.0::DOUBLE - 180 AS lon, (n % 50 + k * 7 + i * i * 3 + j % 12 * 11) % 400 / 10.0::DOUBLE AS vtec
 FROM (SELECT event_id % 30 AS day, count(*) AS n FROM events GROUP BY ALL), (SELECT unnest(range(0, 12)) AS k), (SELECT unnest(range(0, 13)) AS i), (SELECT unnest(range(0, 13)) AS j))"""
add("vtec_maps_read_back", f"SELECT file, time, i, j, lat, lon, round(vtec, 6) + 0.0 AS vtec FROM {_MAPS}")(lambda s, d: _read(s, d).select("file", "time", "i", "j", "lat", "lon", r6(_c("vtec")).alias("vtec")))


def _asked(s, d) -> DataFrame:
    k = _c("c_custkey")
    when = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 29).cast("int"), (k % 22).cast("int"), (k * 7 % 60).cast("int"))
    return t.read(s, d, "customer").select("c_custkey", when.alias("moment"), (k * 13 % 1300 / 10.0 - 65).alias("lat"), (k * 31 % 3590 / 10.0 - 179.5).alias("lon"))


_ASKED = "(SELECT c_custkey, TIMESTAMP '2024-01-01' + to_minutes(CAST(c_custkey % 29 * 1440 + c_custkey % 22 * 60 + c_custkey * 7 % 60 AS BIGINT)) AS moment, c_custkey * 13 % 1300 / 10.0::DOUBLE - 65 AS lat, c_custkey * 31 % 3590 / 10.0::DOUBLE - 179.5 AS lon FROM customer)"


def _bilinear(targets: str, time: str, lon: str, keep: str) -> str:
    """Of ``targets``, at the map of their column ``time``."""
    return f"""(SELECT {keep}, sum(vtec * (1 - abs(lat - y) / 10) * (1 - abs({lon} - x) / 30)) FILTER (true) AS v FROM (SELECT *, 60 - 10 * greatest(0, least(11, floor((60 - lat) / 10))) AS y0, -180 + 30 * greatest(0, least(11, floor(({lon} + 180) / 30))) AS x0 FROM {targets})
 JOIN (SELECT time AS mt, lat AS y, lon AS x, vtec FROM {_MAPS}) m ON mt = {time} AND y IN (y0, y0 - 10) AND x IN (x0, x0 + 30) GROUP BY ALL)"""


# inside the grid the weights of the nodes around are those of a tent; the places asked stay within it but for latitudes beyond 60
_IN = f"(SELECT * FROM {_ASKED} WHERE abs(lat) <= 60)"
_NEAREST = f"(SELECT *, (SELECT min(struct_pack(far := abs(epoch(time) - epoch(moment)), time := time)) FROM (SELECT DISTINCT time FROM {_MAPS})).time AS near FROM {_IN})"
add("vtec_nearest_map", f"SELECT c_custkey, {sr('v')} AS vtec FROM {_bilinear(_NEAREST, 'near', 'lon', 'c_custkey')}")(
    lambda s, d: ionosphere.vtec_at(_asked(s, d).filter("abs(lat) <= 60"), _read(s, d), "moment", "lat", "lon").select("c_custkey", r6(_c("vtec")).alias("vtec"))
)
_TURN = f"(SELECT a.c_custkey, lat, moment, time, 1 - abs(epoch(moment) - epoch(time)) / 7200 AS share, lon + (epoch(moment) - epoch(time)) / 240 - 360 * floor((lon + (epoch(moment) - epoch(time)) / 240 + 180) / 360) AS lon FROM {_IN} a JOIN (SELECT DISTINCT time FROM {_MAPS}) m ON abs(epoch(moment) - epoch(time)) < 7200)"
add("vtec_turning_maps", f"SELECT c_custkey, {sr('sum(v * share)')} AS vtec FROM {_bilinear(_TURN, 'time', 'lon', 'c_custkey, share, time')} GROUP BY c_custkey")(
    lambda s, d: ionosphere.vtec_at(_asked(s, d).filter("abs(lat) <= 60"), _read(s, d), "moment", "lat", "lon", turning=True).select("c_custkey", r6(_c("vtec")).alias("vtec"))
)


def _pair(s, d) -> DataFrame:
    p = _asked(s, d).filter("abs(lat) <= 40").withColumn("lon", _c("lon") * 0.9)
    later = _c("moment") + F.make_dt_interval(F.lit(0), F.lit(1))
    return p.select("c_custkey", "lat", "lon", _c("moment").alias("ref_time"), later.alias("sec_time"), (_c("c_custkey") % 360 * 1.0).alias("ref_azimuth"), (_c("c_custkey") % 350 + 5.0).alias("sec_azimuth"), (45 + _c("c_custkey") % 30 * 1.0).alias("ref_elevation"), (46 + _c("c_custkey") % 30 * 1.0).alias("sec_elevation"))


def _pair_sql() -> str:
    def side(n: int) -> str:
        el, az = f"radians({45 + n} + c_custkey % 30)", ("radians(c_custkey % 360)", "radians(c_custkey % 350 + 5)")[n]
        psi = f"(acos(6371.0 / 6821.0 * cos({el})) - {el})"
        to = f"asin(sin(radians(lat)) * cos({psi}) + cos(radians(lat)) * sin({psi}) * cos({az}))"
        where = f"(SELECT c_custkey, moment + to_hours({n}) AS moment, degrees({to}) AS lat, lon * 0.9 + degrees(asin(sin({psi}) * sin({az}) / cos({to}))) AS lon FROM {_ASKED} WHERE abs(lat) <= 40)"
        near = f"(SELECT *, (SELECT min(struct_pack(far := abs(epoch(time) - epoch(moment)), time := time)) FROM (SELECT DISTINCT time FROM {_MAPS})).time AS near FROM {where})"
        factor = f"4 * pi() * 40.3 * 1e16 / (sin(acos(6371.0 / 6821.0 * cos({el}))) * 299792458.0 * (299792458.0 / 0.05546576))"
        return f"(SELECT c_custkey, v * ({factor}) AS phase FROM {_bilinear(near, 'near', 'lon', 'c_custkey')})"

    return f"SELECT r.c_custkey, {sr('s.phase - r.phase')} AS ionosphere FROM {side(0)} r JOIN {side(1)} s ON s.c_custkey = r.c_custkey"


add("ionosphere_pair_phase", _pair_sql())(lambda s, d: ionosphere.pair_phase(_pair(s, d), _read(s, d)).select("c_custkey", r6(_c("ionosphere")).alias("ionosphere")))
