"""Surfaces and classes fitted to tables: polynomials by sums that Spark takes, forests by its own learner."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import zone_percentiles


def _powers(degree: int) -> list[tuple[int, int]]:
    return [(i, n - i) for n in range(degree + 1) for i in range(n, -1, -1)]


def _monomials(degree: int, x: str, y: str) -> list[Column]:
    raise_ = lambda c, n: F.pow(F.col(c), F.lit(float(n))) if n else F.lit(1.0)
    return [raise_(x, i) * raise_(y, j) for i, j in _powers(degree)]


def polynomial(points: DataFrame, value: str, degree: int = 1, x: str = "x", y: str = "y", weight: Column | None = None) -> dict[tuple[int, int], float]:
    """Coefficients by (power of x, power of y) of the least-squares surface; the driver gets one row of sums.

    Coordinates should be of the size of 1 for degrees above 1. Without enough points the smallest solution is given.
    """
    m, w = _monomials(degree, x, y), weight if weight is not None else F.lit(1.0)
    n = len(m)
    known = points.filter(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    row = known.agg(*[F.coalesce(F.sum(w * m[i] * m[j]), F.lit(0.0)).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)], *[F.coalesce(F.sum(w * m[i] * F.col(value)), F.lit(0.0)).alias(f"b{i}") for i in range(n)]).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    return dict(zip(_powers(degree), np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(n)]), rcond=None)[0].tolist()))


def surface(coefficients: dict[tuple[int, int], float], x: str = "x", y: str = "y") -> Column:
    degree = max(i + j for i, j in coefficients)
    return sum((m * coefficients[p] for p, m in zip(_powers(degree), _monomials(degree, x, y))), F.lit(0.0))


def _median(rows: DataFrame, value: Column) -> float:
    """0 without values; found by ranks, so that no task holds them all."""
    found = zone_percentiles(rows.select(F.lit(0).alias("_z"), value.alias("v")), "_z", [0.5]).first()
    return found["value"] if found else 0.0


def robust_polynomial(points: DataFrame, value: str, degree: int = 1, x: str = "x", y: str = "y", rounds: int = 2, limit: float = 3.0, floor: float = 0.05) -> tuple[dict, DataFrame]:
    """The surface without points that are off by more than ``limit`` scaled median deviations (``floor`` at least), and ``points`` with ``used``."""
    used = F.lit(True)
    for _ in range(rounds + 1):
        c = polynomial(points.filter(used), value, degree, x, y)
        off = F.col(value) - surface(c, x, y)
        middle = _median(points.filter(used), off)
        mad = _median(points.filter(used), F.abs(off - middle))
        used = F.coalesce(F.abs(off - middle) <= max(floor, limit * 1.4826 * mad), F.lit(False))
    return c, points.withColumn("used", used)


def train_forest(samples: DataFrame, features: Sequence[str], label: str, trees: int = 100, test_share: float = 0.25, seed: int = 42) -> tuple[RandomForestClassificationModel, list, float]:
    """(model, labels in order, accuracy on rows held out by a hash). Labels are few."""
    ok = " AND ".join(f"{c} IS NOT NULL" for c in [*features, label])
    names = sorted(r[0] for r in samples.filter(ok).select(label).distinct().collect())
    code = F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, float(i))]), F.col(label))
    rows = VectorAssembler(inputCols=list(features), outputCol="_f").transform(samples.filter(ok).withColumn("_y", code))
    held = F.pmod(F.xxhash64(*features), F.lit(1000)) < int(1000 * test_share)
    model = RandomForestClassifier(featuresCol="_f", labelCol="_y", numTrees=trees, seed=seed, predictionCol="_p").fit(rows.filter(~held))
    right = model.transform(rows.filter(held)).agg(F.avg((F.col("_p") == F.col("_y")).cast("double")).alias("a")).first()["a"]
    return model, names, right if right is not None else float("nan")


def predict_forest(model: RandomForestClassificationModel, labels: list, pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    """``pixels`` with ``class``; null where a feature is missing."""
    ok = " AND ".join(f"{c} IS NOT NULL" for c in features)
    good = model.transform(VectorAssembler(inputCols=list(features), outputCol="_f").transform(pixels.filter(ok)))
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("_p").cast("int") + 1).alias("class")
    return good.select(*pixels.columns, name).unionByName(pixels.filter(f"NOT ({ok})").withColumn("class", F.lit(None)))
