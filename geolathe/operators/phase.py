"""Phase rasters: smoothing, screens, neighbourhood coherence, spectral filtering, and offsets by correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stencil as st

CELL = ["scene_id", "row", "col"]


def radius(sigma: float) -> int:
    return int(4 * sigma + 0.5)


def _smooth(a: np.ndarray, known: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian over the known values alone."""
    r = radius(sigma)
    weight = st.gaussian(known.astype(float), sigma, r)
    return np.where(weight > 1e-6, st.gaussian(np.where(known, a, 0), sigma, r) / np.where(weight > 1e-6, weight, 1), np.nan)


def lowpass(pixels: DataFrame, sigma: float = 2.0, wrapped: bool = False) -> DataFrame:
    """``low``: the known values smoothed; of wrapped phases the angle of their smoothed phasors. Mirrored at the border."""

    def run(x: dict) -> dict:
        v = x["v"]
        known = ~np.isnan(v)
        if not wrapped:
            return {"low": _smooth(v, known, sigma)}
        return {"low": np.arctan2(_smooth(np.sin(v), known, sigma), _smooth(np.cos(v), known, sigma))}

    return st.stencil(pixels, radius(sigma), run, ["low"])


def screen(pixels: DataFrame, sigma: float = 2.0) -> DataFrame:
    """``screen``: values of the chosen pixels (``picked``) spread over all by a Gaussian; null where none is near."""
    return st.stencil(pixels.withColumn("picked", F.col("picked").cast("double")), radius(sigma), lambda x: {"screen": _smooth(x["v"], (x["picked"] > 0) & ~np.isnan(x["v"]), sigma)}, ["screen"], ["v", "picked"])


def neighbourhood_mean(pixels: DataFrame, k: int = 7) -> DataFrame:
    """``near``: the mean of the known pixels of the k x k box but for its centre; null where there is none."""

    def run(x: dict) -> dict:
        here = st.core(x["v"], k // 2)
        n = st.box_sum((~np.isnan(x["v"])).astype(float), k) - ~np.isnan(here)
        return {"near": np.where(n > 0.5, (st.box_sum(x["v"], k) - np.nan_to_num(here)) / np.where(n > 0.5, n, 1), np.nan)}

    return st.stencil(pixels, k // 2, run, ["near"], border="none")


def residual_coherence(stack: DataFrame, k: int = 7) -> DataFrame:
    """(row, col, gamma): how steady over the scenes a pixel's phase is against the mean phasor of its neighbourhood, itself left out."""

    def run(x: dict) -> dict:
        z = np.where(np.isnan(x["v"]), 0, np.exp(1j * np.nan_to_num(x["v"])))
        near = st.box_sum(z.real, k) - st.core(z, k // 2).real + 1j * (st.box_sum(z.imag, k) - st.core(z, k // 2).imag)
        off = st.core(z, k // 2) * np.conj(near) / np.where(np.abs(near) > 1e-12, np.abs(near), np.nan)
        return {"re": off.real, "im": off.imag}

    p = st.stencil(stack, k // 2, run, ["re", "im"], border="none")
    return p.groupBy("row", "col").agg(F.hypot(F.avg("re"), F.avg("im")).alias("gamma"))


def goldstein(pixels: DataFrame, alpha: float = 0.5, window: int = 32, tile: int = st.TILE) -> DataFrame:
    """``out``: wrapped phases whose spectrum, in windows of half overlap, is weighted by its magnitude's share of the window's peak to ``alpha``.

    Windows are blended by raised cosines that are 0 at their ends; pixels that have no weight, along a raster's outer rows and
    columns, keep their phase. Windows start at multiples of half a window and once more at the far edge of the whole raster, and
    a tile has a window's width of halo, so that the result does not depend on the tiles.
    """
    half = max(1, window // 2)
    taper = np.hanning(window)
    taper = taper[:, None] * taper[None]

    def starts(size: int, first: int, last: int) -> list[int]:
        """Of windows over ``size`` rows that reach from ``first`` to ``last``."""
        at = list(range(0, max(1, size - window + 1), half))
        if at[-1] + window < size:
            at.append(max(0, size - window))
        return [x for x in at if x + window > first and x <= last]

    def run(x: dict) -> dict:
        v, row, col = x["v"], x["row_"], x["col_"]
        z = np.where(np.isnan(v), 0, np.exp(1j * np.nan_to_num(v)))
        out, weight = np.zeros_like(z), np.zeros(v.shape)
        for n in range(len(v)):
            # the place of the array's first cell in the raster
            r = int(np.nanmin(row[n])) - int(np.argmax(~np.isnan(row[n]).all(1)))
            c = int(np.nanmin(col[n])) - int(np.argmax(~np.isnan(col[n]).all(0)))
            rows, cols = int(np.nanmax(x["rows_"][n])), int(np.nanmax(x["cols_"][n]))
            high, wide = min(window, rows), min(window, cols)
            if min(high, wide) < 2:
                continue
            for i in starts(rows, r + window, r + v.shape[1] - window - 1):
                for j in starts(cols, c + window, c + v.shape[2] - window - 1):
                    at = n, slice(i - r, i - r + high), slice(j - c, j - c + wide)
                    part = np.fft.fft2(z[at])
                    size = np.abs(part)
                    if size.max() > 0:
                        part = part * (size / size.max()) ** alpha
                    out[at] += np.fft.ifft2(part) * taper[:high, :wide]
                    weight[at] += taper[:high, :wide]
        out = np.where(weight > 0, out / np.where(weight > 0, weight, 1), z)
        return {"out": np.where(np.isnan(st.core(v, window)), np.nan, np.angle(st.core(out, window)))}

    p = pixels.join(st.extents(pixels).select("scene_id", (F.col("r1") + 1).alias("rows_"), (F.col("c1") + 1).alias("cols_")), "scene_id")
    p = p.withColumn("row_", F.col("row")).withColumn("col_", F.col("col"))
    return st.stencil(p, window, run, ["out"], ["v", "row_", "col_", "rows_", "cols_"], border="none", tile=max(tile, window)).drop("row_", "col_", "rows_", "cols_")


def correlate(chip: np.ndarray, search: np.ndarray, least_known: float = 1.0) -> np.ndarray:
    """Normalised correlation of a chip at all places in a larger array; 0 where either is flat.

    Of cells that are NaN in either the rest counts; 0 where that is less than ``least_known`` of the chip.
    """
    w = np.lib.stride_tricks.sliding_window_view(search, chip.shape)
    if np.isnan(chip).any() or np.isnan(search).any():
        known = ~np.isnan(chip) & ~np.isnan(w)
        n = known.sum((-1, -2))
        mean = lambda v: (np.where(known, v, 0).sum((-1, -2)) / np.maximum(n, 1))[..., None, None]
        c, d = np.where(known, chip - mean(chip), 0), np.where(known, w - mean(w), 0)
        norm = np.sqrt((c * c).sum((-1, -2)) * (d * d).sum((-1, -2)))
        use = (norm > 1e-12) & (n >= least_known * chip.size)
        return np.where(use, (c * d).sum((-1, -2)) / np.where(use, norm, 1), 0.0)
    c = chip - chip.mean()
    d = w - w.mean((-1, -2), keepdims=True)
    norm = np.sqrt((c * c).sum() * (d * d).sum((-1, -2)))
    return np.where(norm > 1e-12, (d * c).sum((-1, -2)) / np.where(norm > 1e-12, norm, 1), 0.0)


def peak(surface: np.ndarray) -> tuple[float, float]:
    """The place of the greatest value, between cells by a parabola along each axis."""
    r, c = np.unravel_index(int(surface.argmax()), surface.shape)
    out = []
    for line, at in ((surface[:, c], int(r)), (surface[r], int(c))):
        shift = 0.0
        if 0 < at < len(line) - 1:
            a, b, d = line[at - 1 : at + 2]
            bend = a - 2 * b + d
            shift = 0.5 * (a - d) / bend if bend else 0.0
        out.append(at + shift)
    return out[0], out[1]


def signal_to_noise(surface: np.ndarray, around: int = 2) -> float:
    """The peak over the spread of what lies farther than ``around`` from it."""
    r, c = np.unravel_index(int(surface.argmax()), surface.shape)
    y, x = np.indices(surface.shape)
    rest = surface[(np.abs(y - r) > around) | (np.abs(x - c) > around)]
    return float(surface[r, c] / rest.std()) if len(rest) > 1 and rest.std() > 0 else float("nan")


def offsets(pairs: DataFrame, chip: int = 16, reach: int = 8, step: int = 16, least: float = 3.0, least_known: float = 1.0) -> DataFrame:
    """(scene_id, row, col, d_row, d_col, snr, reliable) at every ``step``-th row and column: by how much a chip of ``a`` around it is moved in ``b``.

    Only places whose chip and search window lie inside the raster and are known are given. With ``least_known`` below 1, as at
    the rim of a raster that is stored in part, so are those that are known in ``a`` with that share of their chip, and the cells
    known in both are compared.
    """
    half = chip // 2 + reach

    def run(x: dict) -> dict:
        a, b, row, col = x["a"], x["b"], x["row_"], x["col_"]
        h, w = a.shape[1] - 2 * half, a.shape[2] - 2 * half
        out = {k: np.full((len(a), h, w), np.nan) for k in ("d_row", "d_col", "snr")}
        at = st.core(row, half) % step + st.core(col, half) % step
        for n, i, j in zip(*np.nonzero(at == 0)):
            one = a[n, i + reach : i + reach + chip, j + reach : j + reach + chip]
            other = b[n, i : i + chip + 2 * reach, j : j + chip + 2 * reach]
            if least_known >= 1 and (np.isnan(one).any() or np.isnan(other).any()):
                continue
            if np.isnan(a[n, i + half, j + half]) or np.isnan(one).mean() > 1 - least_known:
                continue
            surface = correlate(one, other, least_known)
            if least_known < 1 and surface.max() <= 0:
                continue
            y, z = peak(surface)
            out["d_row"][n, i, j], out["d_col"][n, i, j], out["snr"][n, i, j] = y - reach, z - reach, signal_to_noise(surface)
        return out

    p = pairs.withColumn("row_", F.col("row")).withColumn("col_", F.col("col"))
    found = st.stencil(p, half, run, ["d_row", "d_col", "snr"], ["a", "b", "row_", "col_"], border="none")
    return found.filter("d_row IS NOT NULL").select(*CELL, "d_row", "d_col", "snr", (F.coalesce(F.col("snr"), F.lit(0.0)) >= least).alias("reliable"))
