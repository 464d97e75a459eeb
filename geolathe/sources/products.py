"""Products' annotation files, read as whole texts and taken apart by paths: orbit vectors, bursts, radar geometry, calibration tables.

Every function takes (file, content) rows, which ``read_files`` gives; a file that is no such document gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of text files."""
    return spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("content"))


def _all(path: str) -> Column:
    return F.xpath("content", F.lit(f"{path}/text()"))


def _one(path: str) -> Column:
    return F.try_element_at(_all(path), F.lit(1))


def _elements(content: str, path: Sequence[str], names: Sequence[str]) -> Iterator[list[list[str | None]]]:
    """The texts of the parts ``names`` of each element at the end of ``path``, some thousand at a time; none if it is no document."""
    data = content.encode()
    try:
        expat.ParserCreate("utf-8").Parse(data, True)
    except expat.ExpatError:
        return
    stack, found, depth = [], [], len(path)
    place = {n: i for i, n in enumerate(names)}
    row: list | None = None
    at, into = 0, -1

    def start(tag: str, _: dict) -> None:
        nonlocal row, at, into
        stack.append(tag)
        if row is None and stack[-depth:] == path:
            row, at = [None] * len(names), len(stack)
        elif row is not None:
            into = place.get(tag, -1) if len(stack) == at + 1 else -1

    def end(_: str) -> None:
        nonlocal row, into
        if row is not None and len(stack) == at:
            found.append(row)
            row = None
        into = -1
        stack.pop()

    def text(x: str) -> None:
        if into >= 0:
            row[into] = (row[into] or "") + x

    p = expat.ParserCreate("utf-8")
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    for k in range(0, len(data), 1 << 20):
        p.Parse(data[k : k + (1 << 20)], False)
        if found:
            yield found
            found = []
    p.Parse(b"", True)


def _rows(files: DataFrame, at: str, names: Sequence[str]) -> DataFrame:
    """(file, number, names...): a row for each element ``at``, with the texts of its parts, null where it has none; a file is read in one pass."""
    path = at.strip("/").split("/")
    schema = f"file string, number int, {', '.join(f'`{n}` string' for n in names)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                number = 0
                for found in _elements(content.as_py() or "", path, names):
                    columns = [pa.array(c, pa.string()) for c in zip(*found)]
                    numbers = pa.array(range(number, number + len(found)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(found), pa.string()), numbers, *columns], names=["file", "number", *names])
                    number += len(found)

    return files.select("file", "content").mapInArrow(run, schema)


def _time(c: str) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "^[A-Z]+[0-9]*=", "")).cast("timestamp_ntz")


def orbit_vectors(files: DataFrame) -> DataFrame:
    """(file, number, time, x, y, z, vx, vy, vz) of orbit files."""
    rows = _rows(files, "//OSV", ("UTC", "X", "Y", "Z", "VX", "VY", "VZ"))
    return rows.select("file", "number", _time("UTC").alias("time"), *[F.col(n).try_cast("double").alias(n.lower()) for n in ("X", "Y", "Z", "VX", "VY", "VZ")])


def bursts(files: DataFrame) -> DataFrame:
    """(file, number, start, first_valid, lines, interval) of the bursts of annotation files."""
    rows = _rows(files, "//burst", ("azimuthTime", "sensingTime"))
    rest = files.select("file", _one("//linesPerBurst").try_cast("int").alias("lines"), _one("//azimuthTimeInterval").try_cast("double").alias("interval"))
    return rows.join(rest, "file").select("file", "number", _time("azimuthTime").alias("start"), _time("sensingTime").alias("sensed"), "lines", "interval")


def radar_geometry(files: DataFrame) -> DataFrame:
    """(file, slant_range_m, wavelength_m, range_spacing_m, azimuth_spacing_m, incidence_deg, bandwidth_hz) of annotation files."""
    c = 299_792_458.0
    number = lambda path: _one(path).try_cast("double")
    return files.select(
        "file", (number("//slantRangeTime") * c / 2).alias("slant_range_m"), F.try_divide(F.lit(c), number("//radarFrequency")).alias("wavelength_m"), number("//rangePixelSpacing").alias("range_spacing_m"),
        number("//azimuthPixelSpacing").alias("azimuth_spacing_m"), number("//incidenceAngleMidSwath").alias("incidence_deg"), number("//rangeProcessing/processingBandwidth").alias("bandwidth_hz"),
    ).filter("slant_range_m IS NOT NULL")


def calibration_table(files: DataFrame, value: str = "sigmaNought", at: str = "//calibrationVector") -> DataFrame:
    """(file, line, pixel, value): a row for each entry of the vectors of a calibration or noise file."""
    rows = _rows(files, at, ("line", "pixel", value))
    numbers = lambda c, kind: F.transform(F.split(F.trim(F.col(c)), r"\s+"), lambda x: x.try_cast(kind))
    pairs = F.explode(F.arrays_zip(numbers("pixel", "int").alias("pixel"), numbers(value, "double").alias("value"))).alias("x")
    return rows.select("file", F.col("line").try_cast("int").alias("line"), pairs).select("file", "line", "x.pixel", "x.value")


def swaths(files: DataFrame) -> DataFrame:
    """(file, lines, samples, dt, tau0, rate, frequency, steering) of burst annotation: seconds, hertz, and radians a second (files have degrees)."""
    number = lambda path: _one(path).try_cast("double")
    return files.select(
        "file", _one("//linesPerBurst").try_cast("int").alias("lines"), _one("//samplesPerBurst").try_cast("int").alias("samples"), number("//azimuthTimeInterval").alias("dt"), number("//slantRangeTime").alias("tau0"),
        number("//rangeSamplingRate").alias("rate"), number("//radarFrequency").alias("frequency"), F.radians(number("//azimuthSteeringRate")).alias("steering"),
    ).filter("lines IS NOT NULL")


def range_polynomials(files: DataFrame) -> DataFrame:
    """(file, kind, number, time, t0, c): the polynomials of range time for the azimuth rate ("fm") and the Doppler centroid ("dc").

    Coefficients are one list or, in older files, c0, c1 and c2 apart.
    """
    numbers = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.try_cast("double"))
    out = None
    for kind, at, name in (("fm", "//azimuthFmRate", "azimuthFmRatePolynomial"), ("dc", "//dcEstimate", "dataDcPolynomial")):
        listed = F.transform(_all(f"{at}/{name}"), numbers)
        apart = F.arrays_zip(*[_all(f"{at}/c{k}").alias(f"c{k}") for k in range(3)])
        apart = F.transform(apart, lambda x: F.array(*[x[f"c{k}"].try_cast("double") for k in range(3)]))
        rows = F.arrays_zip(_all(f"{at}/azimuthTime").alias("time"), _all(f"{at}/t0").alias("t0"), F.when(F.size(listed) > 0, listed).otherwise(apart).alias("c"))
        part = files.select("file", F.lit(kind).alias("kind"), F.posexplode(rows).alias("number", "x")).select("file", "kind", "number", F.col("x.time").alias("time"), F.col("x.t0").try_cast("double").alias("t0"), "x.c")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("time", _time("time"))
