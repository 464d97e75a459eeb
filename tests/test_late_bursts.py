"""Rows of bursts that start late, where doubles no longer tell a cut from the line beside it."""

from __future__ import annotations

import duckdb
import pytest

from geolathe.plans import registry


@pytest.mark.parametrize("first", [0, 1_000_000, 7_000_000])
def test_burst_rows_of_late_bursts(spark, tmp_path, first):
    duckdb.sql(f"COPY (SELECT i + {first} AS p_partkey, CAST(i * 7 % 50 + 1 AS INTEGER) AS p_size FROM range(4000) t(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    want = sorted(duckdb.sql(registry.oracles()["burst_row_ranges"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")).fetchall())
    got = sorted(tuple(r) for r in registry.queries()["burst_row_ranges"](spark, str(tmp_path)).collect())
    assert got == want
