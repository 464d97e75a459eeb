"""Names, boxes and dates as text: parsing and formatting as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platforms and their short names, and orbits by which a platform's absolute number is off.
PLATFORMS = {"SENTINEL-1A": "S1A", "SENTINEL-1B": "S1B", "SENTINEL-1C": "S1C", "SENTINEL-1D": "S1D", "SENTINEL-2A": "S2A", "SENTINEL-2B": "S2B", "SENTINEL-2C": "S2C", "LANDSAT-8": "L8", "LANDSAT-9": "L9"}
ORBIT_SHIFT = {"S1A": 73, "S1B": 27}
STAMP = r"(\d{8}T\d{6})"


def parse_box(text: Column) -> Column:
    """An array of four doubles from ``a,b,c,d``; null if it is something else."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull()), parts)


def valid_box(text: Column) -> Column:
    """Whether a text is a box of degrees in order."""
    b = parse_box(text)
    return F.coalesce((b[0] >= -180) & (b[2] <= 180) & (b[1] >= -90) & (b[3] <= 90) & (b[0] < b[2]) & (b[1] < b[3]), F.lit(False))


def format_box(box: Sequence[Column], digits: int = 6) -> Column:
    return F.concat_ws(",", *[F.format_string(f"%.{digits}f", c) for c in box])


def _corners(box: Sequence[Column]) -> list[tuple[Column, Column]]:
    x0, y0, x1, y1 = box
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def box_wkt(box: Sequence[Column], between: str = ",") -> Column:
    """A polygon in well-known text."""
    return F.concat(F.lit("POLYGON(("), F.concat_ws(between, *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in _corners(box)]), F.lit("))"))


def box_geojson(box: Sequence[Column]) -> Column:
    ring = F.array(*[F.array(x, y) for x, y in _corners(box)])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def geojson_box(text: Column) -> Column:
    """[min x, min y, max x, max y] of a geometry of any type: of all pairs of numbers that stand in brackets of their own."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    pick = lambda i: F.transform(F.regexp_extract_all(text, F.lit(rf"\[\s*({number})\s*,\s*({number})"), F.lit(i)), lambda x: x.cast("double"))
    xs, ys = pick(1), pick(2)
    return F.when(F.size(xs) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def short_name(platform: Column) -> Column:
    p = F.replace(F.trim(F.upper(F.coalesce(platform, F.lit("")))), F.lit(" "), F.lit("-"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv]), p), p)


def zero_padded(band: Column) -> Column:
    """B4 as B04."""
    return F.regexp_replace(band, r"^([Bb])(\d)(?=\D|$)", "$10$2")


def zero_stripped(band: Column) -> Column:
    """B04 as B4."""
    return F.regexp_replace(band, r"^([Bb])0(\d)", "$1$2")


def platform_of(product: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(product, r"(?i)(S[1-3][A-D])(?:_|$)", 1)), F.lit(""))


def acquired_at(product: Column) -> Column:
    """The first time stamp in a product's name."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(product, STAMP, 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def absolute_orbit(product: Column) -> Column:
    return F.regexp_extract(product, r"_(\d{6})_[0-9A-F]{6}_", 1).try_cast("int")


def relative_orbit(product: Column) -> Column:
    """The track of a product by its platform and absolute orbit; null for other platforms."""
    shift = F.try_element_at(F.create_map(*[F.lit(x) for kv in ORBIT_SHIFT.items() for x in kv]), platform_of(product))
    return F.pmod(absolute_orbit(product) - shift, F.lit(175)) + 1


def validity(orbit_file: Column) -> tuple[Column, Column]:
    """Start and end of the time that an orbit file's name says it is valid for."""
    at = lambda i: F.try_to_timestamp(F.nullif(F.regexp_extract(orbit_file, rf"V{STAMP}_{STAMP}", i), F.lit("")), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    return at(1), at(2)


def covers(orbit_file: Column, time: Column) -> Column:
    start, end = validity(orbit_file)
    return F.coalesce((start <= time) & (time <= end), F.lit(False))


def cloud_range(text: Column) -> Column:
    """[least, most] of ``a-b``; null unless 0 <= a <= b <= 100."""
    parts = F.transform(F.split(text, "-"), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == 2) & (parts[0] >= 0) & (parts[0] <= parts[1]) & (parts[1] <= 100), parts)


def iso_date(text: Column) -> Column:
    """A date of the form 2024-01-31; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def date_range(name: Column, today: Column) -> tuple[Column, Column]:
    """Start and end of last_7_days, last_30_days, last_year, or ``start,end``."""
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in {"last_7_days": 7, "last_30_days": 30, "last_year": 365}.items() for x in kv]), name)
    ends = F.split(name, ",")
    return F.coalesce(F.date_sub(today, days), iso_date(ends[0])), F.coalesce(F.when(days.isNotNull(), today), iso_date(F.try_element_at(ends, F.lit(2))))


def julian_start(text: Column) -> Column:
    """The time of ``sYYYYDDDHHMMSS`` in a file's name, to the second."""
    s = lambda i, n: F.substr(F.regexp_extract(text, r"_s(\d{13})", 1), F.lit(i), F.lit(n)).try_cast("int")
    day = F.date_add(F.make_date(s(1, 4), F.lit(1), F.lit(1)), s(5, 3) - 1)
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), s(8, 2), s(10, 2), s(12, 2))


def hour_prefixes(product: str, start: Column, end: Column) -> Column:
    """``product/year/day of year/hour/`` of each hour from start to end."""
    hours = F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end), F.expr("INTERVAL 1 HOUR"))
    return F.transform(hours, lambda h: F.concat(F.lit(f"{product}/"), F.date_format(h, "yyyy/DDD/HH"), F.lit("/")))


def fingerprint(*parts: Column) -> Column:
    """A hash of inputs and settings, by which work can be taken up again."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def is_data(key: Column, media_type: Column, roles: Column, href: Column) -> Column:
    """Whether an asset holds data, by the first rule that says so: roles, media type, key, extension."""
    aside = F.lower(key).rlike(r"thumbnail|preview|tilejson|rendered|visual|\.json|readme")
    raster = F.lower(media_type).rlike(r"tiff|jp2|hdf|netcdf|zarr")
    return (
        F.when((F.size(roles) > 0) & F.forall(roles, lambda r: r.isin("thumbnail", "overview", "metadata", "visual")), False)
        .when(media_type.isNotNull() & ~raster, False)
        .when(aside, False)
        .when(F.lower(href).rlike(r"\.(json|xml|html|txt|png|jpe?g)$"), False)
        .when(raster, True)
        .otherwise(F.exists(roles, lambda r: r == "data") | F.lower(href).rlike(r"\.(tiff?|jp2|nc|h5|hdf|zarr)$"))
    )


def grade(stages: Column, flags: Column) -> Column:
    """science with all stages done and no flag, quicklook with all done, else degraded. stages: an array of booleans."""
    done = F.forall(stages, lambda s: F.coalesce(s, F.lit(False)))
    return F.when(done & (F.size(flags) == 0), "science").when(done, "quicklook").otherwise("degraded")
