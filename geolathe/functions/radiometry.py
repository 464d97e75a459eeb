"""Radiometry as column expressions: scaling, calibration, masks, topographic correction, pan-sharpening, flood rules, uncertainty."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, pi, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import WAVELENGTH_M, to_db

# Thermal constants K1, K2, gain, offset by sensor.
THERMAL = {"landsat": (774.8853, 1321.0789, 3.342e-4, 0.1), "modis": (607.76, 1260.56, 1.0, 0.0)}
# Scene classes of clouds, shadows and snow; bits of the quality band for dilated cloud, cloud and shadow.
CLOUD_CLASSES = (3, 8, 9, 10, 11)
QA_BITS = (1, 3, 4)


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def landsat_scaled(dn: Column, thermal: bool = False) -> Column:
    """Surface reflectance or temperature of a digital number; 0 is no data."""
    return F.when(dn != 0, dn * 0.00341802 + 149.0 if thermal else dn * 2.75e-5 - 0.2)


def land_surface_temperature(dn: Column, sensor: str = "landsat", emissivity: float = 0.97) -> Column:
    """Kelvin by the single-channel formula."""
    k1, k2, gain, offset = THERMAL[sensor]
    bright = k2 / F.log(k1 / (dn * gain + offset) + 1)
    return bright / (1 + 10.8e-6 * bright / 1.438e-2 * F.log(F.lit(emissivity)))


def has_bits(qa: Column, bits: Sequence[int] = QA_BITS) -> Column:
    return qa.bitwiseAND(sum(1 << b for b in bits)) != 0


def cloudy(method: str, bands: Sequence[Column], classes: Sequence[int] = CLOUD_CLASSES) -> Column:
    """scl: a class band; fmask: bright and white over four bands of reflectance x 10,000; threshold: one band of
    reflectance above 0.8; ndsi: second band against fourth above 0.4."""
    if method == "scl":
        return bands[0].cast("int").isin(*classes)
    if method == "fmask":
        b = [x / 10_000 for x in bands[:4]]
        mean = sum(b[1:], b[0]) / 4
        off = [F.abs(x - mean) for x in b]
        return (mean > 0.3) & (F.try_divide(sum(off[1:], off[0]), mean) < 0.7)
    if method == "threshold":
        return bands[0] > 0.8
    if method == "ndsi":
        return F.try_divide(bands[1] - bands[3], bands[1] + bands[3]) > 0.4
    raise ValueError(f"unknown method: {method}")


def atmosphere(band: Column, method: str, dark: Column | None = None) -> Column:
    """dos1: less the dark value, which ``detect.subtract_dark`` finds; dos2: that by 1.05; sen2cor: reflectance clipped to [0, 1]."""
    if method == "sen2cor":
        return _clip(band / 10_000, 0.0, 1.0)
    out = F.when(band > 0, band - dark).otherwise(0.0)
    return out * 1.05 if method == "dos2" else out


def topographic(band: Column, slope_deg: Column, method: str, c: Column | None = None, k: float = 0.5, sun_zenith_deg: float = 45.0) -> Column:
    """cosine, minnaert or c: by slope alone under one sun; ``c`` is intercept over slope of the band on the cosine of incidence."""
    z = cos(radians(sun_zenith_deg))
    i = F.cos(F.radians(slope_deg)) * z
    if method == "cosine":
        return band * F.try_divide(F.lit(z), F.greatest(i, F.lit(0.01)))
    if method == "minnaert":
        return band * F.pow(F.try_divide(F.lit(z), F.greatest(i, F.lit(0.01))), F.lit(k))
    if method == "c":
        return band * F.try_divide(z + c, i + c)
    raise ValueError(f"unknown method: {method}")


def cosine_of_incidence(slope_deg: Column, aspect_deg: Column, zenith_deg: Column, azimuth_deg: Column) -> Column:
    s, z = F.radians(slope_deg), F.radians(zenith_deg)
    return F.cos(s) * F.cos(z) + F.sin(s) * F.sin(z) * F.cos(F.radians(azimuth_deg - aspect_deg))


def cosine_corrected(band: Column, slope_deg: Column, aspect_deg: Column, zenith_deg: Column, azimuth_deg: Column) -> Column:
    """By slope and aspect under a given sun."""
    return band * F.cos(F.radians(zenith_deg)) / F.greatest(cosine_of_incidence(slope_deg, aspect_deg, zenith_deg, azimuth_deg), F.lit(0.05))


def pansharpened(pan: Column, bands: Sequence[Column], method: str = "brovey") -> list[Column]:
    """brovey: shares of the sum; ihs: over the mean of the first three, or the first of fewer; gram_schmidt and mean: over the mean of all.

    Where the intensity is not positive, all but brovey leave the bands as they are.
    """
    total = sum(bands[1:], bands[0])
    if method == "brovey":
        return [b / (total + 1e-10) * pan for b in bands]
    over = {"ihs": sum(bands[1:3], bands[0]) / 3 if len(bands) >= 3 else bands[0], "gram_schmidt": total / len(bands), "mean": total / len(bands)}[method]
    return [b * F.when(over > 0, pan / (over + 1e-10)).when(over.isNotNull(), 1.0) for b in bands]


def calibrated(dn: Column, kind: str = "sigma0", db: bool = True, lut: Column | None = None, noise: Column | None = None, floor: float = 1e-10) -> Column:
    """Backscatter of a digital number. Without a table: sigma0, gamma0 or beta0 at a fixed 38 degrees; with one: (DN^2 - noise) / A^2, null where not positive."""
    if lut is not None:
        power = F.try_divide(dn * dn - (noise if noise is not None else F.lit(0.0)), lut * lut)
        power = F.when(power > 0, power)
        return to_db(power) if db else power
    power = dn * dn * {"sigma0": 1.0, "gamma0": cos(radians(38)), "beta0": 1 / sin(radians(38))}[kind]
    return 10 * F.log10(F.greatest(power, F.lit(floor))) if db else power


def flooded(db: Column, threshold: float = -15.0, reference: Column | None = None, direction: str = "decrease") -> Column:
    """Below the threshold; or, against a reference date, changed by half of it: decrease, increase or both."""
    if reference is None:
        return db < threshold
    drop, least = reference - db, abs(0.5 * threshold)
    return {"decrease": drop > least, "increase": drop < -least, "both": F.abs(drop) > least}[direction]


def fused_flood(optical: Column, sar: Column, valid: Column, how: str = "cloud_aware") -> Column:
    """Where the optical date is valid: it alone, or joined with the radar's; else the radar's."""
    both = {"cloud_aware": optical, "union": optical | sar, "intersection": optical & sar}[how]
    return F.when(valid, both).otherwise(sar)


def optical_valid(scene_class: Column, green: Column, nir: Column) -> Column:
    """Not a cloud or shadow class, and not both bands 0."""
    return ~scene_class.cast("int").isin(3, 8, 9, 10) & ~((green == 0) & (nir == 0)) & (green + nir != 0)


def change_class(pre: Column, post: Column, threshold: float) -> Column:
    """Whether ``post`` is off by more than the threshold; null where either is unknown."""
    return F.abs(post - pre) > threshold


def disturbance(ndvi_pre: Column, ndvi_post: Column, coherence: Column, drop: float = 0.2, least: float = 0.3) -> Column:
    """1 where greenness fell, else 2 where coherence is low, else 0 where both are known, else 255."""
    return F.when(ndvi_pre - ndvi_post > drop, 1).when(coherence < least, 2).when((ndvi_pre - ndvi_post).isNotNull() & coherence.isNotNull(), 0).otherwise(255)


def phase_uncertainty(coherence: Column, looks: float, wavelength: float = WAVELENGTH_M) -> dict[str, Column]:
    """Standard deviations of phase and displacement."""
    g = _clip(coherence, 1e-6, 0.999999)
    phase = F.sqrt(1 - g * g) / (g * (2 * looks) ** 0.5)
    return {"sigma_phase": phase, "sigma_displacement": phase * (wavelength / (4 * pi))}


def fused_velocity(insar: Column, coherence: Column, optical: Column, snr: Column | None = None, low: float = 0.4, high: float = 0.6) -> dict[str, Column]:
    """A blend by coherence, one alone where the other is missing; ``source`` 2 for the radar's, 0 for the optical one, 1 for both."""
    w = _clip((coherence - low) / (high - low), 0.0, 1.0)
    there = optical.isNotNull() & (F.coalesce(snr, F.lit(0.0)) >= 1 if snr is not None else F.lit(True))
    w = F.when(insar.isNull() & ~there, F.lit(None)).when(~there, 1.0).when(insar.isNull(), 0.0).otherwise(w)
    value = F.when(w.isNull(), F.lit(None)).when(w >= 1, insar).when(w <= 0, optical).otherwise(w * insar + (1 - w) * optical)
    return {"weight": w, "fused": value, "source": F.when(w >= 1, 2).when(w <= 0, 0).otherwise(1)}


def risk_index(velocity: Column, strain: Column, curvature: Column, how: str = "max_weighted") -> Column:
    """0 to 100 from velocity, strain and curvature against their references; strain is capped."""
    score = lambda x, ref: _clip(100 * F.abs(x) / ref, 0.0, 100.0)
    parts = [score(velocity, 0.5), score(F.least(F.abs(strain), F.lit(0.1)), 0.01), score(curvature, 0.001)]
    mean = sum(parts[1:], parts[0]) / 3
    return 0.6 * F.greatest(*parts) + 0.4 * mean if how == "max_weighted" else mean


def stability_weight(adi: Column, scale: float = 0.4) -> Column:
    return F.pow(1 - _clip(adi / scale, 0.0, 1.0), F.lit(2.0))
