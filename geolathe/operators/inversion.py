"""Displacement series from interferogram networks: many pixels' least-squares problems solved together, closures, referencing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import pi, radians, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import WAVELENGTH_M
from . import stencil as st

#: Interferogram values that are solved together.
TOGETHER = 1 << 16


def _fitted(pixel: np.ndarray, d1: np.ndarray, d2: np.ndarray, moved: np.ndarray, weight: np.ndarray, n: int) -> tuple:
    """(displacements by pixel and place of the date, places of d1 and of d2, (pixel and day of each date, first and number of a pixel's))."""
    keys, code = np.unique(np.concatenate((pixel, pixel)) * np.int64(1 << 32) + np.concatenate((d1, d2)), return_inverse=True)
    of, date = keys >> 32, keys & 0xFFFFFFFF
    first = np.searchsorted(of, np.arange(n))
    count = np.diff(np.append(first, len(of)))
    most = int(count.max(initial=1))
    at = code - first[np.concatenate((pixel, pixel))]
    i, j = at[: len(pixel)], at[len(pixel) :]
    normal, right = np.zeros((n, most, most)), np.zeros((n, most))
    for a, b, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
        np.add.at(normal, (pixel, a, b), sign * weight)
    np.add.at(right, (pixel, j), weight * moved)
    np.add.at(right, (pixel, i), -weight * moved)
    # the first date and the places beyond a pixel's last one stay at zero
    none = (np.arange(most)[None] >= count[:, None]) | (np.arange(most)[None] == 0)
    normal[none[:, :, None] | none[:, None, :]] = 0
    right[none] = 0
    p, k = np.nonzero(none)
    normal[p, k, k] = 1
    try:
        x = np.linalg.solve(normal, right[..., None])[..., 0]
        if not np.isfinite(x).all():
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        x = (np.linalg.pinv(normal, hermitian=True) @ right[..., None])[..., 0]
    return x, (i, j), (of, date, first, count)


def solve(pixel: np.ndarray, d1: np.ndarray, d2: np.ndarray, moved: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(dates, how many, displacements, rms, velocity a year) of ``n`` pixels: weighted least squares from each one's first date.

    Pixels are 0 to n - 1 and their dates numbers. Of a network in several parts the smallest solution is taken.
    """
    x, (i, j), (of, date, first, count) = _fitted(pixel, d1, d2, moved, weight, n)
    most = x.shape[1]
    off = moved - (x[pixel, j] - x[pixel, i])
    rms = np.sqrt(np.bincount(pixel, off * off, n) / np.maximum(np.bincount(pixel, minlength=n), 1))
    t = np.zeros((n, most))
    t[of, np.arange(len(of)) - first[of]] = (date - date[first][of]) / 365.25
    real = np.arange(most)[None] < count[:, None]
    mean = lambda v: (v * real).sum(1) / np.maximum(count, 1)
    ct, cx = (t - mean(t)[:, None]) * real, (x - mean(x)[:, None]) * real
    with np.errstate(all="ignore"):
        velocity = (ct * cx).sum(1) / (ct * ct).sum(1)
    return date, count, x, rms, velocity


def by_pixel(rows: DataFrame, pixel: str, *order: str) -> DataFrame:
    """``rows`` with those of a pixel together and in order, numbered in ``_n``; the window leaves them in their partitions if they are dealt by pixel."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(pixel).orderBy(*order)))


def _dealt(ifg: DataFrame, pixel: str, wavelength: float, weight: Column, *more: Column) -> DataFrame:
    """(pixel, d1, d2, m in metres, w, more...), a pixel's pairs together."""
    used = ifg.select(F.col(pixel).cast("long").alias("pixel"), F.col("d1").cast("long"), F.col("d2").cast("long"), (F.col("phase") * (wavelength / (4 * pi))).cast("double").alias("m"), weight.cast("double").alias("w"), *more)
    return by_pixel(used, "pixel", "d1", "d2")


def _by_pixel(compute: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``compute`` over tables of whole pixels, many of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            p = t.column("pixel").to_numpy()
            last = int(np.searchsorted(p, p[-1]))  # the last pixel may go on
            if last:
                yield compute(t.slice(0, last))
                t = t.slice(last)
                held, size = t.to_batches(), len(t)
        if size:
            yield compute(pa.Table.from_batches(held))

    return run


def invert(ifg: DataFrame, pixel: str = "pixel", wavelength: float = WAVELENGTH_M, least_coherence: float = 0.0, bridge_penalty: float = 1.0) -> DataFrame:
    """(pixel, velocity, rms, n, n_dates) from (pixel, d1, d2, phase, coherence) rows, days as whole numbers from 0.

    A pixel's pairs weigh by their squared coherence, those in a column ``bridge``, if there is one, by
    ``bridge_penalty`` of it; pairs below ``least_coherence`` are left out, and so are pixels that have fewer pairs
    left than dates less one. A pixel's first date is the reference. A pixel has a bounded number of pairs.
    """
    weight = F.col("coherence") * F.col("coherence")
    if "bridge" in ifg.columns:
        weight = weight * F.when(F.col("bridge"), bridge_penalty).otherwise(1.0)
    dealt = _dealt(ifg.filter((F.col("coherence") >= least_coherence) & F.col("phase").isNotNull()), pixel, wavelength, weight)

    def compute(t: pa.Table) -> pa.RecordBatch:
        p, d1, d2, m, w = (t.column(c).to_numpy() for c in ("pixel", "d1", "d2", "m", "w"))
        names, code = np.unique(p, return_inverse=True)
        _, dates, _, rms, velocity = solve(code, d1, d2, m, w, len(names))
        n = np.bincount(code, minlength=len(names))
        ok = n >= dates - 1
        return pa.RecordBatch.from_arrays([pa.array(names[ok]), pa.array(velocity[ok], from_pandas=True), pa.array(rms[ok]), pa.array(n[ok]), pa.array(dates[ok].astype(np.int64))], names=["pixel", "velocity", "rms", "n", "n_dates"])

    return dealt.mapInArrow(_by_pixel(compute), "pixel long, velocity double, rms double, n long, n_dates long").withColumnRenamed("pixel", pixel)


def joint_velocity(ifg: DataFrame, slant_range: float, incidence: float, pixel: str = "pixel", wavelength: float = WAVELENGTH_M, least_share: float = 1e-9) -> DataFrame:
    """(pixel, velocity, height, n) from (pixel, d1, d2, phase, baseline, coherence): a steady motion a year and an error of the heights, solved together.

    A pair's phase is 4 pi / wavelength times (years between its dates) * velocity + baseline / (slant range * sin incidence)
    * height; pairs weigh by their squared coherence, and those with an unknown value are left out. Both unknowns are null
    where years and baselines are in proportion, that is where the determinant is below ``least_share`` of its diagonal.
    """
    w, t = F.col("coherence") * F.col("coherence"), (F.col("d2") - F.col("d1")) / 365.25
    b, m = F.col("baseline") / (slant_range * sin(radians(incidence))), F.col("phase") * (wavelength / (4 * pi))
    used = ifg.select(pixel, w.alias("w"), t.alias("t"), b.alias("b"), m.alias("m")).dropna(subset=["w", "t", "b", "m"])
    total = lambda x, y: F.sum(F.col("w") * F.col(x) * F.col(y))
    sums = used.groupBy(pixel).agg(*[total(x, y).alias(f"{x}{y}") for x, y in ("tt", "bb", "tb", "tm", "bm")], F.count("*").alias("n"))
    whole = F.col("tt") * F.col("bb") - F.col("tb") * F.col("tb")
    det = F.when(whole > least_share * F.col("tt") * F.col("bb"), whole)
    velocity = (F.col("tm") * F.col("bb") - F.col("bm") * F.col("tb")) / det
    return sums.select(pixel, velocity.alias("velocity"), ((F.col("bm") * F.col("tt") - F.col("tm") * F.col("tb")) / det).alias("height"), "n")


def joint_series(ifg: DataFrame, slant_range: float, incidence: float, pixel: str = "pixel", wavelength: float = WAVELENGTH_M, least_share: float = 1e-9) -> DataFrame:
    """(pixel, velocity, height, rms, n, n_dates): a displacement of each date after the first and an error of the heights, solved together.

    As ``invert``, with a column for the height: baseline / (slant range * sin incidence). Where pairs' baselines are the
    differences of one value a date, the height cannot be told from displacements; if the part of that column which no
    displacements explain is below ``least_share`` of it, the height is null and the dates are solved alone.
    """
    weight = F.col("coherence") * F.col("coherence")
    lever = F.col("baseline") / (slant_range * sin(radians(incidence)))
    used = ifg.filter(F.col("phase").isNotNull() & F.col("coherence").isNotNull() & F.col("baseline").isNotNull())
    dealt = _dealt(used, pixel, wavelength, weight, lever.cast("double").alias("b"))

    def compute(t: pa.Table) -> pa.RecordBatch:
        p, d1, d2, m, w, b = (t.column(c).to_numpy() for c in ("pixel", "d1", "d2", "m", "w", "b"))
        names, code = np.unique(p, return_inverse=True)
        k = len(names)
        n = np.bincount(code, minlength=k)
        # what displacements leave unexplained of the levers and of the phases
        left = []
        for v in (b, m):
            x, at, _ = _fitted(code, d1, d2, v, w, k)
            left.append(v - (x[code, at[1]] - x[code, at[0]]))
        rest = np.bincount(code, w * left[0] * left[0], k)
        told = rest > least_share * np.bincount(code, w * b * b, k)
        with np.errstate(all="ignore"):
            height = np.where(told, np.bincount(code, w * left[0] * left[1], k) / rest, np.nan)
        _, dates, _, rms, velocity = solve(code, d1, d2, m - np.nan_to_num(height)[code] * b, w, k)
        ok = n >= dates - 1
        return pa.RecordBatch.from_arrays([pa.array(names[ok]), *[pa.array(c[ok], from_pandas=True) for c in (velocity, height)], pa.array(rms[ok]), pa.array(n[ok]), pa.array(dates[ok].astype(np.int64))], names=["pixel", "velocity", "height", "rms", "n", "n_dates"])

    return dealt.mapInArrow(_by_pixel(compute), "pixel long, velocity double, height double, rms double, n long, n_dates long").withColumnRenamed("pixel", pixel)


def referenced(ifg: DataFrame, pixel: str = "pixel") -> DataFrame:
    """``ifg`` with the phase of each pair less that of the pixel with the best mean coherence, the smallest of equals."""
    best = ifg.groupBy(pixel).agg(F.avg("coherence").alias("_c")).agg(F.min_by(pixel, F.struct(-F.col("_c"), F.col(pixel))).alias("_ref"))  # one row
    base = ifg.join(F.broadcast(best), F.col(pixel) == F.col("_ref")).select("d1", "d2", F.col("phase").alias("_p"))
    return ifg.join(base, ["d1", "d2"], "left").withColumn("phase", F.col("phase") - F.coalesce("_p", F.lit(0.0))).drop("_p")


def _matches(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all want[i] = have[j]."""
    order = np.argsort(have, kind="stable")
    low = np.searchsorted(have, want, "left", order)
    n = np.searchsorted(have, want, "right", order) - low
    return np.repeat(np.arange(len(want)), n), order[np.repeat(low, n) + st._ranges(n)]


def threes(pixel: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs (a, b), (b, c) and (a, c) of each three dates that a pixel's pairs join; pixels are numbers from 0."""
    dates, code = np.unique(np.concatenate((first, second)), return_inverse=True)
    d1, d2, k = code[: len(first)], code[len(first) :], max(1, len(dates))
    ab, bc = _matches(pixel * k + d1, pixel * k + d2)
    i, ac = _matches((pixel * k + d1) * k + d2, (pixel[ab] * k + d1[ab]) * k + d2[bc])
    return ab[i], bc[i], ac


def closures(ifg: DataFrame, pixel: str = "pixel") -> DataFrame:
    """(pixel, a, b, c, closure, cycles): the phases of each triangle of dates and the whole cycles that they are off. A pixel has a bounded number of pairs."""
    e = by_pixel(ifg.select(pixel, "d1", "d2", F.col("phase").cast("double").alias("phase")).dropna(subset=[pixel, "d1", "d2"]), pixel, "d1", "d2")

    def compute(t: pa.Table) -> pa.RecordBatch:
        own = np.zeros(len(t), np.int64)
        own[st._starts(t, [pixel])[1:]] = 1
        d1, d2 = (t.column(c).to_numpy() for c in ("d1", "d2"))
        ab, bc, ac = (pa.array(x) for x in threes(own.cumsum(), d1, d2))
        phase = t.column("phase")
        closure = pc.subtract(pc.add(phase.take(ab), phase.take(bc)), phase.take(ac))
        columns = [t.column(pixel).take(ab), t.column("d1").take(ab), t.column("d2").take(ab), t.column("d2").take(bc), closure]
        return pa.table(columns, names=[pixel, "a", "b", "c", "closure"]).combine_chunks().to_batches()

    kind = {n: e.schema[n].dataType.simpleString() for n in (pixel, "d1", "d2")}
    schema = f"{pixel} {kind[pixel]}, a {kind['d1']}, b {kind['d2']}, c {kind['d2']}, closure double"
    run = st.grouped(compute, [pixel])
    t = e.mapInArrow(lambda batches: (b for made in run(batches) for b in made), schema)
    return t.select("*", F.rint(F.col("closure") / (2 * pi)).cast("long").alias("cycles"))


def dem_error(residual: DataFrame, by: str = "pixel", least_baseline: float = 10.0, least_coherence: float = 0.3) -> DataFrame:
    """(by, beta): the residual phase a metre of baseline, weighted by squared coherence over pairs with a long enough one."""
    w = F.col("coherence") * F.col("coherence")
    used = residual.filter((F.abs("baseline") > least_baseline) & (F.col("coherence") > least_coherence))
    return used.groupBy(by).agg(F.try_divide(F.sum(w * F.col("baseline") * F.col("residual")), F.sum(w * F.col("baseline") * F.col("baseline"))).alias("beta"))
