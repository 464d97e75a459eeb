"""Every registered core query against its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from geolathe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    """In the order of the values, doubles to five places."""
    cell = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, float) else str(x).removesuffix(" 00:00:00") if not isinstance(x, (int, bool)) else int(x)
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(cell(x.item() if hasattr(x, "item") else x) for x in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: str([round(x, 5) + 0.0 if isinstance(x, float) else x for x in r]))


def _near(a, b) -> bool:
    """A double that was rounded to another side of a tie is not near."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 5e-7 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows(spark, duck, name):
    want, got = duck.execute(registry.oracles()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    want, got = _rows(want), _rows(got)
    assert len(want) == len(got)
    assert all(_near(x, y) for r, q in zip(want, got) for x, y in zip(r, q)), next((r, q) for r, q in zip(want, got) if not all(map(_near, r, q)))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
