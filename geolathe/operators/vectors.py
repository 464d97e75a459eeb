"""Polygons as arrays of corners (x, y): measures, predicates, clipping, simplification, and joins on a grid of cells.

A polygon is one ring, its first corner not repeated, in any direction. Columns hold ``array<struct<x:double,y:double>>``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def sides(r: Column) -> Column:
    """An array of (a, b): each corner with the next one."""
    return F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _turn(s: Column) -> Column:
    return s.a.x * s.b.y - s.b.x * s.a.y


def signed_area(r: Column) -> Column:
    return _sum(F.transform(sides(r), _turn)) / 2


def measures(r: Column) -> dict[str, Column]:
    """area, perimeter and compactness (1 for a circle)."""
    area = F.abs(signed_area(r))
    round_ = _sum(F.transform(sides(r), lambda s: F.hypot(s.b.x - s.a.x, s.b.y - s.a.y)))
    return {"area": area, "perimeter": round_, "compactness": 4 * np.pi * area / (round_ * round_ + 1e-10)}


def centroid(r: Column) -> dict[str, Column]:
    six = 6 * signed_area(r)
    at = lambda c: F.try_divide(_sum(F.transform(sides(r), lambda s: (s.a[c] + s.b[c]) * _turn(s))), F.nullif(six, F.lit(0.0)))
    return {"cx": at("x"), "cy": at("y")}


def contains(r: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the sides that a ray to the right crosses; of two polygons with a common side one has its points."""
    crossed = F.filter(sides(r), lambda s: ((s.a.y > y) != (s.b.y > y)) & (x < (s.b.x - s.a.x) * (y - s.a.y) / F.nullif(s.b.y - s.a.y, F.lit(0.0)) + s.a.x))
    return F.size(crossed) % 2 == 1


def envelope(r: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(r, lambda p: p.x), F.transform(r, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def widened(r: Column, distance: float) -> Column:
    """The box around a polygon, wider by ``distance`` on each side."""
    x0, y0, x1, y1 = envelope(r)
    return box_ring(x0 - distance, y0 - distance, x1 + distance, y1 + distance)


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """The grid cells that a box touches, as numbers."""
    rows, cols = F.sequence(F.floor(y0 / size), F.floor(y1 / size)), F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    return F.flatten(F.transform(rows, lambda i: F.transform(cols, lambda j: i * (1 << 31) + j)))


def join_points(points: DataFrame, polygons: DataFrame, size: float, how: str = "inner", x: str = "x", y: str = "y", ring_: str = "ring") -> DataFrame:
    """Points with the polygons that hold them: an equality join on grid cells, then the exact test.

    ``size`` is the side of a cell: about that of a common polygon. left keeps points in none.
    """
    p = points.withColumn("_cell", F.floor(F.col(y) / size) * (1 << 31) + F.floor(F.col(x) / size))
    z = polygons.withColumn("_zone", F.explode(cells(*envelope(F.col(ring_)), size)))
    return p.join(z, (F.col("_cell") == F.col("_zone")) & contains(F.col(ring_), F.col(x), F.col(y)), how).drop("_cell", "_zone")


def join_boxes(a: DataFrame, b: DataFrame, size: float, touching: bool = True) -> DataFrame:
    """Pairs of rows whose boxes (ax0, ay0, ax1, ay1; bx0, ...) overlap, each once: met in the cell of the overlap's lower left corner."""
    left = a.withColumn("_cell", F.explode(cells(*[F.col(f"a{c}") for c in ("x0", "y0", "x1", "y1")], size)))
    right = b.withColumn("_zone", F.explode(cells(*[F.col(f"b{c}") for c in ("x0", "y0", "x1", "y1")], size)))
    first = F.floor(F.greatest("ay0", "by0") / size) * (1 << 31) + F.floor(F.greatest("ax0", "bx0") / size)
    meet = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    if not touching:
        meet = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))
    return left.join(right, (F.col("_cell") == F.col("_zone")) & meet & (F.col("_cell") == first)).drop("_cell", "_zone")


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A polygon (corners, 2) cut to a convex one: empty where they do not meet."""
    if len(window) < 3:
        return window[:0]
    x, y = window[:, 0], window[:, 1]
    if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
        window = window[::-1]
    out = subject
    for a, b in zip(window, np.roll(window, -1, 0)):
        if not len(out):
            return out
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept: list[np.ndarray] = []
        for p, q, s, t in zip(out, np.roll(out, -1, 0), side, np.roll(side, -1)):
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                kept.append(p + (q - p) * (s / (s - t)))
        out = np.array(kept).reshape(-1, 2)
    return out


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A line (corners, 2) without the corners that lie within ``tolerance`` of the line between those kept around them."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, p = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            spans += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[keep]


def _corners(r) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2)


def _ring(a: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in a]


def clipped(subject: Column, window: Column) -> Column:
    """The part of each polygon in a convex one (intersection)."""

    @F.pandas_udf(RING)
    def run(subject: pd.Series, window: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or w is None else _ring(clip(_corners(s), _corners(w))) for s, w in zip(subject, window)])

    return run(subject, window)


def simplified(r: Column, tolerance: float) -> Column:
    """A ring, taken as a line back to its first corner, which stays, without the corners that matter less than ``tolerance``."""

    @F.pandas_udf(RING)
    def run(r: pd.Series) -> pd.Series:
        out = []
        for x in r:
            a = None if x is None else _corners(x)
            out.append(None if a is None else _ring(simplify(np.concatenate((a, a[:1])), tolerance)[:-1]) if len(a) else [])
        return pd.Series(out)

    return run(r)


def overlaid(pairs: DataFrame, how: str = "intersection") -> DataFrame:
    """``area`` of two polygons (a, b; b convex): of their intersection, union, difference or symmetric difference."""
    size = lambda r: F.abs(signed_area(r))
    both = size(F.col("_cut"))
    a, b = size(F.col("a")), size(F.col("b"))
    area = {"intersection": both, "union": a + b - both, "difference": a - both, "symmetric_difference": a + b - 2 * both}[how]
    return pairs.withColumn("_cut", clipped(F.col("a"), F.col("b"))).withColumn("area", area).drop("_cut")
