"""Risk of trends by drawing: residual bootstrap and Monte Carlo, repeatable whatever the partitions.

A pixel's draws come from a counter-based generator whose key is the seed and the pixel's hash, one row a replicate, so
neither partitions, order nor retries change them. Replicates are a matrix beside a pixel's dates, never rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values drawn at a time.
TOGETHER = 1 << 20


def slopes(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least-squares slopes of the rows of ``v`` over ``t``."""
    d = t - t.mean()
    total = (d * d).sum()
    return v @ d / total if total > 0 else np.zeros(len(v))


def _risks(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The slope over the spread; 0 with fewer than three dates."""
    return np.abs(slopes(t, v)) / (v.std(1) + 1e-10) if len(t) > 2 else np.zeros(len(v))


def _drawn(t: np.ndarray, v: np.ndarray, how: str, replicates: int, key: int, seed: int, noise: float) -> np.ndarray:
    """The risk of each replicate."""
    rng = np.random.Generator(np.random.Philox(key=np.array([seed, key], np.uint64)))
    out = []
    step = max(1, TOGETHER // max(len(t), 1))
    line = v.mean() + slopes(t, v[None])[0] * (t - t.mean())
    for at in range(0, replicates, step):
        n = min(step, replicates - at)
        if how == "bootstrap":
            out.append(_risks(t, line + (v - line)[rng.integers(0, len(t), (n, len(t)))]))
        else:
            out.append(_risks(t, v + rng.normal(0, noise, (n, len(t)))))
    return np.concatenate(out)


def drawn_risk(series: DataFrame, by: Sequence[str], t: Column, how: str = "bootstrap", replicates: int = 1000, confidence: float = 0.95, seed: int = 0, noise: float | None = None) -> DataFrame:
    """(by, risk, std, lo, hi): mean, spread and interval over ``replicates`` of the slope of ``v`` over its spread.

    bootstrap: each pixel's trend is fitted once, its residuals are drawn again and put back on the line. monte_carlo: normal noise is added, of
    deviation ``noise`` or that of all values. Unknown values and times take no part; a pixel with one or two has risk 0, with none no row. A
    pixel's dates meet in one row.
    """
    if how not in ("bootstrap", "monte_carlo"):
        raise ValueError(f"unknown way of drawing: {how!r}")
    known = series.select(*by, t.cast("double").alias("_t"), F.col("v").cast("double").alias("_v")).filter("_t IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_v)")
    if how == "monte_carlo" and noise is None:
        noise = known.agg(F.stddev_pop("_v")).first()[0] or 0.0
    rows = known.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_t", "_v"))).alias("_x")).withColumn("_key", F.xxhash64(*by))
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField(n, T.DoubleType()) for n in ("risk", "std", "lo", "hi")])
    ends = [(1 - confidence) / 2, (1 + confidence) / 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(by))
            flat, at = x.flatten(), np.cumsum([0, *[len(v) for v in x]])
            when, value = (flat.field(n).to_numpy() for n in ("_t", "_v"))
            found = []
            for key, a, b in zip(batch.column(len(by) + 1).to_numpy().view(np.uint64), at[:-1], at[1:]):
                r = _drawn(when[a:b], value[a:b], how, replicates, int(key), seed, noise or 0.0)
                found.append((r.mean(), r.std(), *np.quantile(r, ends)))
            columns = np.array(found).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *map(pa.array, columns)], names=[*by, "risk", "std", "lo", "hi"])

    return rows.mapInArrow(run, schema)
