"""Spectral indices as column expressions over bands named blue, green, red, red_edge, nir, nir1 and swir1 to swir5.

Two styles exist side by side: ``guarded`` gives null on a zero denominator and is not clipped; ``clipped`` adds a
small constant to the denominator and clips to [-1, 1] where the index is a normalised one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerator and denominator of each index in the clipped style.
CLIPPED = {
    "ndvi": ("nir - red", "nir + red + 1e-10"),
    "evi": ("2.5 * (nir - red)", "nir + 6 * red - 7.5 * blue + 1 + 1e-10"),
    "savi": ("1.5 * (nir - red)", "nir + red + 0.5"),
    "ndwi": ("green - nir", "green + nir + 1e-10"),
    "mndwi": ("green - swir1", "green + swir1 + 1e-10"),
    "ndbi": ("swir1 - nir", "swir1 + nir + 1e-10"),
    "ndsi": ("green - swir1", "green + swir1 + 1e-10"),
    "ndmi": ("nir - swir1", "nir + swir1 + 1e-10"),
    "nbr": ("nir - swir2", "nir + swir2 + 1e-10"),
    "bsi": ("(swir1 + red) - (nir + blue)", "(swir1 + red) + (nir + blue) + 1e-10"),
    "arvi": ("nir - (2 * red - blue)", "nir + (2 * red - blue) + 1e-10"),
    "gndvi": ("nir - green", "nir + green + 1e-10"),
    "vci": ("nir - red", "nir + red + blue + 1e-10"),
    "psri": ("red - blue", "nir + 1e-10"),
    "cri1": ("green - blue", "(blue + 1e-10) * (green + 1e-10)"),
}
RATIOS = {"rvi": ("nir", "red + 1e-10"), "fox": ("nir", "red + 1e-10"), "akp": ("swir1 + swir3", "swir2 + 1e-10"), "alt": ("swir3", "swir5 + 1e-10"), "gos": ("swir4", "red + 1e-10"), "amp": ("swir1", "swir2 + 1e-10")}
GUARDED = {
    "ndvi": ("nir - red", "nir + red"),
    "evi": ("2.5 * (nir - red)", "nir + 6 * red - 7.5 * blue + 1"),
    "savi": ("1.5 * (nir - red)", "nir + red + 0.5"),
    "ndwi": ("green - nir", "green + nir"),
    "nbr": ("nir - swir2", "nir + swir2"),
    "ndmi": ("nir - swir1", "nir + swir1"),
    "ndre": ("nir - red_edge", "nir + red_edge"),
    "mndwi": ("green - swir1", "green + swir1"),
    "ndbi": ("swir1 - nir", "swir1 + nir"),
    "ndsi": ("green - swir1", "green + swir1"),
}
# Tasseled cap rows over blue, green, red, nir, swir1, swir2.
TASSELED = {
    "sentinel2": {"brightness": (0.3510, 0.3813, 0.3437, 0.7196, 0.2396, 0.1949), "greenness": (-0.3599, -0.3533, -0.4734, 0.6633, 0.0087, -0.2856), "wetness": (0.2578, 0.2305, 0.0883, 0.1071, -0.7611, -0.5308)},
    "landsat8": {"brightness": (0.3029, 0.2786, 0.4733, 0.5599, 0.5080, 0.1872), "greenness": (-0.2941, -0.2430, -0.5424, 0.7276, 0.0713, -0.1608), "wetness": (0.1511, 0.1973, 0.3283, 0.3407, -0.7117, -0.4559)},
}
# Albedo coefficients and intercept.
ALBEDO = {"sentinel2": ((0.160, 0.291, 0.243, 0.116, 0.112, 0.081), -0.0015), "landsat8": ((0.356, 0.130, 0.373, 0.085, 0.072, -0.0018), -0.0018)}
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")


def clipped(name: str) -> Column:
    if name in RATIOS:
        a, b = RATIOS[name]
        return F.try_divide(F.expr(a), F.expr(b))
    a, b = CLIPPED[name]
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.expr(a), F.expr(b))))


def guarded(name: str) -> Column:
    a, b = GUARDED[name]
    return F.try_divide(F.expr(a), F.expr(b))


def combination(weights: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for w, b in zip(weights, BANDS):
        out = out + F.lit(w) * F.col(b)
    return out


def tasseled_cap(sensor: str) -> dict[str, Column]:
    return {k: combination(w) for k, w in TASSELED[sensor].items()}


def albedo(sensor: str) -> Column:
    w, c = ALBEDO[sensor]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), combination(w) + c))


def fei() -> Column:
    """A sum of two ratios, not clipped."""
    return F.try_divide(F.col("swir5"), F.col("red") + 1e-10) + F.try_divide(F.col("nir1"), F.col("green") + 1e-10)


def dnbr(nir_before: Column, swir2_before: Column, nir_after: Column, swir2_after: Column, eps: float = 0.0) -> Column:
    """Burn ratio before less after, not clipped; ``eps`` 1e-10 in the clipped style, else null on a zero denominator."""
    ratio = lambda n, s: F.try_divide(n - s, n + s + eps)
    return ratio(nir_before, swir2_before) - ratio(nir_after, swir2_after)


def info() -> list[tuple[str, str, str, str, bool]]:
    """(index, style, formula, bands, clipped) of all that there are."""
    out = []
    for style, table in (("clipped", CLIPPED), ("ratio", RATIOS), ("guarded", GUARDED)):
        for name, (a, b) in table.items():
            used = [x for x in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", re.sub(r"1e-10", "", f"{a} {b}")))]
            out.append((name, style, f"({a}) / ({b})", " ".join(used), style == "clipped"))
    return out
