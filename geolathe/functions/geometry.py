"""Distances, boxes, line-of-sight geometry and radar scalars as column expressions."""

from __future__ import annotations

from math import pi, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
WAVELENGTH_M = 0.05546576
WGS84_A, WGS84_B = 6378137.0, 6356752.314245


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """(min x, min y, max x, max y) of both; touching counts."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def los_to_vertical(displacement: Column, incidence_deg: Column) -> Column:
    return F.try_divide(displacement, F.cos(F.radians(incidence_deg)))


def phase_to_displacement(phase: Column, wavelength: float = WAVELENGTH_M) -> Column:
    return phase * (wavelength / (4 * pi))


def to_db(power: Column) -> Column:
    return F.when(power > 0, 10 * F.log10(power))


def ecef(lat: Column, lon: Column, height: Column) -> dict[str, Column]:
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    flat = (n + height) * F.cos(F.radians(lat))
    return {"x": flat * F.cos(F.radians(lon)), "y": flat * F.sin(F.radians(lon)), "z": (n * (1 - e2) + height) * F.sin(F.radians(lat))}


def ionosphere_phase(tec: Column, incidence_deg: Column, wavelength: float = WAVELENGTH_M, shell_km: float = 450.0) -> Column:
    c = 299792458.0
    elevation = F.acos(EARTH_KM / (EARTH_KM + shell_km) * F.cos(F.radians(90 - incidence_deg)))
    return 4 * pi * 40.3 * tec * 1e16 / (F.sin(elevation) * c * (c / wavelength))


def tile_id(lat: Column, lon: Column) -> Column:
    """South-west corner of the 1 degree cell, like N035E138."""
    y, x = F.floor(lat), F.floor(lon)
    part = lambda v, pos, neg: F.concat(F.when(v >= 0, pos).otherwise(neg), F.lpad(F.abs(v).cast("string"), 3, "0"))
    return F.concat(part(y, "N", "S"), part(x, "E", "W"))


def geodetic(x: Column, y: Column, z: Column, passes: int = 6) -> dict[str, Column]:
    """Latitude, longitude and height of earth-centred coordinates by a fixed point, ``passes`` times."""
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    p = F.sqrt(x * x + y * y)
    start = F.struct(F.atan2(z, p * (1 - e2)).alias("lat"))

    def again(at: Column, _: Column) -> Column:
        n = WGS84_A / F.sqrt(1 - e2 * F.sin(at.lat) * F.sin(at.lat))
        return F.struct(F.atan2(z + e2 * n * F.sin(at.lat), p).alias("lat"))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, again)["lat"]
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    # from the horizontal distance, or near the poles from the vertical one
    height = F.when(F.abs(F.cos(lat)) > 1e-6, F.try_divide(p, F.cos(lat)) - n).otherwise(F.abs(z) - WGS84_B)
    return {"lat": F.degrees(lat), "lon": F.degrees(F.atan2(y, x)), "height": height}


def range_offset_to_vertical(offset_px: Column, spacing_m: float, incidence_deg: Column) -> Column:
    return F.try_divide(-offset_px * spacing_m, F.cos(F.radians(incidence_deg)))


def offsets_in_metres(range_px: Column, azimuth_px: Column, range_spacing: float, azimuth_spacing: float) -> dict[str, Column]:
    return {"range_m": range_px * range_spacing, "azimuth_m": azimuth_px * azimuth_spacing}


def line_of_sight(east: Column, north: Column, up: Column, incidence_deg: Column, heading_deg: Column) -> Column:
    """Displacement towards a right-looking sensor's line of sight."""
    i, h = F.radians(incidence_deg), F.radians(heading_deg + 90)
    return east * F.sin(i) * F.sin(h) + north * F.sin(i) * F.cos(h) + up * F.cos(i)


def east_north(range_m: Column, azimuth_m: Column, incidence_deg: Column, heading_deg: Column, up: Column) -> dict[str, Column]:
    """East and north displacement from offsets along range and azimuth with a known vertical one."""
    i, h = F.radians(incidence_deg), F.radians(heading_deg)
    r = range_m + up * F.cos(i)
    return {
        "east": F.try_divide(F.cos(h) * r - F.sin(i) * F.sin(h) * azimuth_m, -F.sin(i)),
        "north": F.try_divide(-F.sin(h) * r - F.sin(i) * F.cos(h) * azimuth_m, -F.sin(i)),
    }


def east_up(range_m: Column, azimuth_m: Column, incidence_deg: Column, heading_deg: Column) -> dict[str, Column]:
    """East and vertical displacement where none is to the north."""
    i, h = F.radians(incidence_deg), F.radians(heading_deg)
    east = F.try_divide(azimuth_m, F.sin(h))
    return {"east": east, "up": F.try_divide(-range_m - east * F.sin(i) * F.cos(h), F.cos(i))}


def delay_phase(zenith_delay_m: Column, incidence_deg: Column, wavelength: float = WAVELENGTH_M) -> Column:
    return 4 * pi / wavelength * zenith_delay_m / F.cos(F.radians(incidence_deg))


def wrapped(phase: Column) -> Column:
    """The phase in [-pi, pi)."""
    return F.pmod(phase + pi, F.lit(2 * pi)) - pi


def pierce_point(lat_deg: Column, lon_deg: Column, azimuth_deg: Column, elevation_deg: Column, shell_km: float = 450.0) -> dict[str, Column]:
    """Where the line of sight crosses the ionospheric shell."""
    lat, az, el = F.radians(lat_deg), F.radians(azimuth_deg), F.radians(elevation_deg)
    psi = F.acos(EARTH_KM / (EARTH_KM + shell_km) * F.cos(el)) - el
    to = F.asin(F.sin(lat) * F.cos(psi) + F.cos(lat) * F.sin(psi) * F.cos(az))
    return {"ipp_lat": F.degrees(to), "ipp_lon": lon_deg + F.degrees(F.asin(F.sin(psi) * F.sin(az) / F.cos(to)))}


def mapping_function(incidence_deg: Column, shell_km: float = 450.0) -> Column:
    """Slant over vertical path through a thin shell."""
    return 1 / F.sin(F.acos(EARTH_KM / (EARTH_KM + shell_km) * F.cos(F.radians(90 - incidence_deg))))


def topographic_phase(baseline_m: Column, slant_range_m: float = 850_000.0, incidence_deg: float = 39.0, wavelength: float = WAVELENGTH_M) -> Column:
    """Phase of 100 m of relief."""
    return 4 * pi / wavelength * F.abs(baseline_m) / (slant_range_m * sin(radians(incidence_deg))) * 100


def perpendicular_baseline(a: tuple[Column, ...], b: tuple[Column, ...], ground: tuple[Column, ...]) -> Column:
    """Distance of two positions across the line of sight from the first one."""
    base, look = [y - x for x, y in zip(a, b)], [g - x for x, g in zip(a, ground)]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    along = F.try_divide(dot(base, look) * dot(base, look), dot(look, look))
    return F.sqrt(F.greatest(F.lit(0.0), dot(base, base) - along))


def solar_position(hour_utc: Column, day_of_year: Column, lat_deg: Column, lon_deg: Column) -> dict[str, Column]:
    """Zenith and azimuth of the sun in degrees, by the usual Fourier series of declination and equation of time."""
    g = 2 * pi * (day_of_year - 1) / 365
    # The series' coefficients.
    time = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    dec = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    turn = F.radians((60 * hour_utc + time + 4 * lon_deg) / 4 - 180)
    lat = F.radians(lat_deg)
    cz = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(turn)))
    z = F.acos(cz)
    ca = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -(F.sin(lat) * cz - F.sin(dec)) / (F.cos(lat) * F.sin(z) + 1e-12)))
    a = F.degrees(F.acos(ca))
    return {"zenith": F.degrees(z), "azimuth": F.when(F.sin(turn) > 0, 360 - a).otherwise(a)}


def degree_cell_area_m2(lat_deg: Column, height_deg: float, width_deg: float) -> Column:
    """Area of a cell of a degree grid on the sphere of 111,320 m a degree."""
    return F.abs(F.lit(height_deg) * 111_320.0 * width_deg * 111_320.0 * F.cos(F.radians(lat_deg)))


def box_area_km2(box: tuple[Column, ...]) -> Column:
    x0, y0, x1, y1 = box
    return haversine_km(y0, x0, y0, x1) * haversine_km(y0, x0, y1, x0)


def in_box(lon: Column, lat: Column, box: tuple[Column, ...]) -> Column:
    return (lon >= box[0]) & (lon <= box[2]) & (lat >= box[1]) & (lat <= box[3])


def shared_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area of the overlap of two boxes, in their units."""
    side = lambda i, j: F.greatest(F.lit(0.0), F.least(a[j], b[j]) - F.greatest(a[i], b[i]))
    return side(0, 2) * side(1, 3)


def hour_weights(time: Column) -> Column:
    """An array of (hour, weight): the full hours around a time, weighing linearly."""
    start = F.date_trunc("hour", time)
    part = (F.unix_micros(time.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9
    return F.array(F.struct(start.alias("hour"), (1 - part).alias("weight")), F.struct((start + F.expr("INTERVAL 1 HOUR")).alias("hour"), part.alias("weight")))


def pixel_window(box: tuple[Column, ...], origin: tuple[float, float], step: tuple[float, float], size: tuple[int, int], slack: float = 1e-9) -> dict[str, Column]:
    """First and one past the last row and column of a north-up grid that a box touches, rounded outwards and cut to
    the grid, and the share of the box that the grid has. step: degrees a column and a row, both positive."""
    x0, y0, x1, y1 = box
    left, right = (x0 - origin[0]) / step[0], (x1 - origin[0]) / step[0]
    top, bottom = (origin[1] - y1) / step[1], (origin[1] - y0) / step[1]
    cut = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n), v))
    c0, c1 = F.floor(left + slack), F.ceil(right - slack)
    r0, r1 = F.floor(top + slack), F.ceil(bottom - slack)
    kept = F.greatest(F.lit(0), cut(c1, size[1]) - cut(c0, size[1])) * F.greatest(F.lit(0), cut(r1, size[0]) - cut(r0, size[0]))
    return {"row0": cut(r0, size[0]), "row1": cut(r1, size[0]), "col0": cut(c0, size[1]), "col1": cut(c1, size[1]), "coverage": F.try_divide(kept, (c1 - c0) * (r1 - r0))}


def window_bounds(row0: Column, row1: Column, col0: Column, col1: Column, origin: tuple[float, float], step: tuple[float, float]) -> dict[str, Column]:
    """The box of a window of rows and columns."""
    return {"min_lon": origin[0] + col0 * step[0], "min_lat": origin[1] - row1 * step[1], "max_lon": origin[0] + col1 * step[0], "max_lat": origin[1] - row0 * step[1]}


def tiles_covering(box: tuple[Column, ...]) -> Column:
    """The names of the 1 degree cells that a box touches, south to north, then west to east."""
    rows, cols = F.sequence(F.floor(box[1]), F.ceil(box[3]) - 1), F.sequence(F.floor(box[0]), F.ceil(box[2]) - 1)
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: tile_id(y.cast("double"), x.cast("double")))))
