"""Rows that clusters are trained on lie in blocks of bounded size."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans

from geolathe.operators import detect


def test_blocks_are_bounded_and_every_row_has_its_cluster(spark, monkeypatch):
    monkeypatch.setattr(detect, "ROWS", 100, raising=False)
    blocks, fit = [], KMeans.fit

    def noted(self, rows):
        blocks.extend(r["n"] for r in rows.groupBy(detect.F.spark_partition_id()).agg(detect.F.count("*").alias("n")).collect())
        return fit(self, rows)

    monkeypatch.setattr(KMeans, "fit", noted)
    rows = [(i, float(i % 3 * 100 + i % 7), 1.0 if i % 50 else None) for i in range(2000)]
    p = spark.createDataFrame(rows, "id int, a double, b double").coalesce(1)
    got = detect.kmeans(p, ["a", "b"], 3).toPandas()
    again = detect.kmeans(p, ["a", "b"], 3).toPandas()
    assert sum(blocks) == 2 * 1960 and max(blocks) <= 200
    assert sorted(got["id"]) == list(range(2000)) and (got.set_index("id").sort_index() == again.set_index("id").sort_index())["cluster"].all()
    assert (got[got["b"].isna()]["cluster"] == -1).all()
    known = got[got["b"].notna()]
    assert known.groupby(known["id"] % 3)["cluster"].nunique().eq(1).all() and known["cluster"].nunique() == 3
