"""Offsets where a raster is stored in part."""

from __future__ import annotations

import duckdb
import numpy as np

from __spark_entry__ import oracle_sql, queries
from geolathe.operators import phase


def test_offsets_of_a_raster_without_its_last_tiles(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("vec_id BETWEEN 32 AND 42").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries()["offset_tracking"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert len(got) == 9 and got == sorted(c.execute(oracle_sql()["offset_tracking"]).fetchall())


def test_correlation_of_known_cells():
    rng = np.random.default_rng(1)
    search = rng.standard_normal((9, 9))
    chip = search[2:7, 3:8].copy()
    chip[0], search[:, 8] = np.nan, np.nan
    got = phase.correlate(chip, search, 0.5)
    assert np.unravel_index(got.argmax(), got.shape) == (2, 3) and abs(got.max() - 1) < 1e-9
    for r, c in np.ndindex(got.shape):
        x, y = chip.ravel(), search[r : r + 5, c : c + 5].ravel()
        k = ~np.isnan(x + y)
        assert abs(got[r, c] - np.corrcoef(x[k], y[k])[0, 1]) < 1e-9
    assert (phase.correlate(chip, search, 0.9) == 0).all()
