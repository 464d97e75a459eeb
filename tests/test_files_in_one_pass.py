"""Annotation files read in one pass, part by part of each element."""

from __future__ import annotations

from geolathe.sources import products


def test_a_missing_part_is_null_and_moves_no_other(spark):
    osv = "".join(f"<OSV a='1'><UTC>UTC=2024-01-01T00:00:{i % 60:02d}</UTC>{'' if i % 3 == 0 else f'<X>{i}</X>'}<Y>&#49;{i}</Y><Z><!-- <OSV> -->2</Z></OSV>" for i in range(30000))
    files = spark.createDataFrame([("a", f"<r><l><UTC>0</UTC>{osv}</l></r>"), ("b", "<r><OSV><X>1</X></OSV>"), ("c", None), ("d", "text")], "file string, content string")
    got = products.orbit_vectors(files).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(30000)) and {r["file"] for r in got} == {"a"}
    assert all(r["x"] == (None if i % 3 == 0 else float(i)) and r["y"] == float(f"1{i}") and r["z"] == 2.0 and r["vx"] is None and r["time"].second == i % 60 for i, r in enumerate(got))
