"""Ionosphere maps: files of the published form, nodes, edges, times between maps."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geolathe.operators import ionosphere
from geolathe.sources import ionex

PAD = " " * 60


def _line(text: str, label: str) -> str:
    return f"{text:<60}{label}\n"


def _file(maps: dict, exponent: str | None = "-1", lats=(50.0, 47.5, 45.0), lon=(-180.0, 180.0, 90.0)) -> str:
    out = _line("     1.1            IONOSPHERE MAPS     GNSS", "IONEX VERSION / TYPE")
    out += _line(f"{exponent:>6}", "EXPONENT") if exponent else ""
    out += _line(f"  {lats[0]:6.1f}{lats[-1]:6.1f}{-2.5:6.1f}", "LAT1 / LAT2 / DLAT") + _line("", "END OF HEADER")
    for n, (epoch, rows) in enumerate(maps.items(), 1):
        for kind, add in (("TEC", 0), ("RMS", 5000)):
            out += _line(f"{n:6d}", f"START OF {kind} MAP") + _line("".join(f"{x:6d}" for x in epoch), "EPOCH OF CURRENT MAP")
            for lat, values in zip(lats, rows):
                out += _line(f"  {lat:6.1f}{lon[0]:6.1f}{lon[1]:6.1f}{lon[2]:6.1f}{450.0:6.1f}", "LAT/LON1/LON2/DLON/H")
                out += "".join(f"{v + add:5d}" for v in values[:3]) + "\n" + "".join(f"{v + add:5d}" for v in values[3:]) + "\n"
            out += _line(f"{n:6d}", f"END OF {kind} MAP")
    return out + _line("", "END OF FILE")


MAPS = {
    (2024, 1, 15, 0, 0, 0): [[100, 110, 120, 130, 100], [200, 210, 220, 230, 200], [300, -10, 320, 330, 300]],
    (2024, 1, 15, 2, 0, 0): [[140, 150, 160, 170, 140], [240, 250, 260, 270, 240], [340, 350, 9999, 370, 340]],
    (2024, 1, 15, 24, 0, 0): [[1, 2, 3, 4, 5]] * 3,
}


@pytest.fixture(scope="module")
def maps(spark):
    rows = [("a", _file(MAPS)), ("b", "no map at all"), ("c", "END OF HEADER\nnothing"), ("d", None), ("e", "")]
    return ionex.vtec_maps(spark.createDataFrame(rows, "file string, content string")).cache()


def test_reads_the_published_form(spark, maps):
    got = {(r["time"], r["lat"], r["lon"]): r["vtec"] for r in maps.collect()}
    assert len(got) == 45 and {t for t, *_ in got} == {datetime(2024, 1, 15), datetime(2024, 1, 15, 2), datetime(2024, 1, 16)}
    assert got[datetime(2024, 1, 15), 47.5, -90.0] == pytest.approx(21.0) and got[datetime(2024, 1, 15), 45.0, -90.0] == pytest.approx(-1.0)
    assert got[datetime(2024, 1, 15, 2), 45.0, 0.0] is None and got[datetime(2024, 1, 16), 50.0, 180.0] == pytest.approx(0.5)
    one = ionex.vtec_maps(spark.createDataFrame([("a", _file(MAPS, "0")), ("b", _file(MAPS, None))], "file string, content string"))
    assert {r["file"]: r["v"] for r in one.groupBy("file").agg(F.max("vtec").alias("v")).collect()} == {"a": 370.0, "b": 37.0}


def test_there_and_back(spark, maps):
    again = ionex.vtec_maps(ionex.as_files(maps))
    assert sorted(map(str, again.collect())) == sorted(map(str, maps.collect()))


def _ask(spark, maps, rows, **how):
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, moment timestamp_ntz, lat double, lon double")
    got = ionosphere.vtec_at(t, maps, "moment", "lat", "lon", **how)
    assert got.columns == ["id", "moment", "lat", "lon", "vtec"]
    return [r["vtec"] for r in sorted(got.collect(), key=lambda r: r["id"])]


def test_nodes_are_exact_and_places_between_bilinear(spark, maps):
    zero, two, day = datetime(2024, 1, 15), datetime(2024, 1, 15, 2), datetime(2024, 1, 16)
    got = _ask(spark, maps, [(zero, 50.0, -180.0), (zero, 45.0, 180.0), (two, 47.5, 0.0), (zero, 48.75, -135.0), (datetime(2024, 1, 15, 1), 50.0, 0.0), (datetime(2024, 1, 15, 1, 0, 1), 50.0, 0.0), (zero, 51.0, -180.0), (two, 45.5, 10.0), (day, 46.0, 90.0), (datetime(2024, 1, 20), 50.0, 0.0), (None, 50.0, 0.0), (zero, None, 0.0)])
    assert got[:4] == pytest.approx([10.0, 30.0, 26.0, 15.5])
    assert got[4] == pytest.approx(12.0) and got[5] == pytest.approx(16.0)  # the earlier of equals, then the nearer
    assert got[6] == pytest.approx(10.0 - 0.4 * 10) and got[7] is None and got[8] == pytest.approx(0.4) and got[9:] == [None] * 3


def test_maps_that_turn_with_the_sun(spark, maps):
    at = datetime(2024, 1, 15, 1)
    got = _ask(spark, maps, [(at, 50.0, 0.0), (datetime(2024, 1, 15), 50.0, -90.0), (datetime(2024, 1, 14, 23), 50.0, 0.0)], turning=True)
    assert got[0] == pytest.approx((12 + 15 / 90) / 2 + (16 - 15 / 90) / 2) and got[1] == pytest.approx(11.0) and got[2] is None


def test_phase_of_a_pair(spark, maps):
    zero, two = datetime(2024, 1, 15), datetime(2024, 1, 15, 2)
    px = spark.createDataFrame([(1, 47.5, 0.0, zero, 90.0, 90.0, two, 0.0, 90.0), (2, 47.5, 0.0, zero, 90.0, 90.0, zero, 0.0, 90.0)], "id int, lat double, lon double, ref_time timestamp_ntz, ref_azimuth double, ref_elevation double, sec_time timestamp_ntz, sec_azimuth double, sec_elevation double")
    got = {r["id"]: r["ionosphere"] for r in ionosphere.pair_phase(px, maps).collect()}
    assert got[2] == pytest.approx(0.0) and got[1] == pytest.approx(4 * math.pi * 40.3 * 4e16 / (299792458.0**2 / 0.05546576), rel=1e-6)
