"""The catalog source: what is read back, what is pushed, and which files stay closed."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import functions as F

from geolathe.sources import catalog_source as cs

SCENES = "id string, provider string, collection string, datetime timestamp_ntz, cloud_cover double, min_lon double, min_lat double, max_lon double, max_lat double"


def catalog(spark, path) -> list[tuple]:
    rows = [(f"s{i}", f"prov {i % 3}", "c", datetime(2024, 1 + i % 5, 1 + i % 28, i % 24), None if i % 7 == 0 else float(i % 100), 1.0 * i, 2.0, 1.0 * i + 1, 3.0) for i in range(300)]
    cs.write_catalog(spark.createDataFrame(rows, SCENES), f"file://{path}/c")
    return rows


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_items_come_back(spark, tmp_path):
    rows = catalog(spark, tmp_path)
    got = cs.read_catalog(spark, f"file://{tmp_path}/c").drop("assets").collect()
    assert sorted(map(tuple, got)) == sorted(rows, key=lambda r: r[0])


def test_searches_are_pushed_and_other_files_stay_closed(spark, tmp_path):
    rows = catalog(spark, tmp_path)
    for folder, _, files in os.walk(tmp_path / "c"):
        if "provider=prov" in folder and not ("prov 1" in folder or "prov%201" in folder) or folder.endswith(("month=2024-01", "month=2024-05")):
            for f in files:
                os.remove(os.path.join(folder, f))
                os.mkfifo(os.path.join(folder, "x" + f.strip(".")))  # opening one would never end
    df = cs.read_catalog(spark, f"file://{tmp_path}/c").filter((F.col("provider") == "prov 1") & (F.col("datetime") >= datetime(2024, 2, 10)) & (F.col("datetime") < datetime(2024, 4, 20)) & (F.col("cloud_cover") <= 50))
    shown = plan(df)
    assert "PushedFilters" in shown and "EqualTo(provider" in shown and "LessThanOrEqual(cloud_cover" in shown
    left = next(line for line in shown.splitlines() if line.startswith("Condition"))
    assert "datetime" in left and "<= 50" not in left and "prov 1" not in left  # the rest is settled by the source
    want = sorted(r[0] for r in rows if r[1] == "prov 1" and datetime(2024, 2, 10) <= r[3] < datetime(2024, 4, 20) and r[4] is not None and r[4] <= 50)
    assert sorted(r.id for r in df.collect()) == want and want


def test_odd_items(tmp_path):
    assert cs.row_of("no json", "p") is None and cs.row_of("[1]", "p") is None
    assert cs.row_of("{}", "p") == (None, "p", None, None, None, None, None, None, None, None)
    got = cs.row_of('{"id": 7, "bbox": [1, 2, "x", 4], "properties": {"datetime": "2024-01-01T02:00:00+02:00", "cloudCover": "3.5"}, "assets": {}}', "p")
    assert got == ("7", "p", None, datetime(2024, 1, 1), 3.5, 1.0, 2.0, None, 4.0, "{}")
    reader = cs.CatalogReader(f"file://{tmp_path}/none")
    assert [p.paths for p in reader.partitions()] == [[]]
    assert list(reader.read(reader.partitions()[0])) == []
