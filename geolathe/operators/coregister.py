"""Coregistration: where a pair's orbits put a ground point in both images, a field of offsets through that, and resampling at fractional places.

Resampling is a gather: each request goes to the tile of the raster that its place lies in, each pixel to its tile and those in whose
rim it lies, and a tile's requests are interpolated together. Fields are fitted to a pair's control points, a few dozen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ecef
from .geolocation import zero_doppler
from .hydrology import _kept as kept

#: Rows and columns before and behind a place that a kernel needs.
REACH = {"nearest": (0, 1), "linear": (0, 1), "cubic": (1, 2)}


def _weights(kernel: str, u: np.ndarray) -> np.ndarray:
    """(places, taps) for fractions ``u`` from 0 to 1."""
    if kernel == "nearest":
        return np.stack([u < 0.5, u >= 0.5], 1).astype(float)
    if kernel == "linear":
        return np.stack([1 - u, u], 1)
    return np.stack([((-0.5 * u + 1) * u - 0.5) * u, (1.5 * u - 2.5) * u * u + 1, ((-1.5 * u + 2) * u + 0.5) * u, (0.5 * u - 0.5) * u * u], 1)


def resampled(raster: DataFrame, requests: DataFrame, values: Sequence[str] = ("v",), kernel: str = "cubic", tile: int = 256, together: int = 1 << 18) -> DataFrame:
    """``requests`` (scene_id, row, col, at_row, at_col) with ``values`` of the raster (scene_id, row, col) at the fractional places.

    A value is null where a place is null or not finite, or where a pixel that has a weight is missing or unknown. Cubic interpolation gives
    back surfaces of the second degree. Of a pixel given twice one counts. Requests of one tile are dealt in lots of about ``together``, each of which takes the tile. The requests are read several times: keep them
    where they are costly.
    """
    before, behind = REACH[kernel]
    asked = requests.select("scene_id", "row", "col", F.col("at_row").cast("double").alias("at_row"), F.col("at_col").cast("double").alias("at_col"))
    fine = F.col("at_row").isNotNull() & F.col("at_col").isNotNull() & (F.abs("at_row") < 2**30) & (F.abs("at_col") < 2**30)
    number = lambda c: F.floor(F.floor(F.col(c)) / tile).cast("int")
    q = asked.filter(fine).withColumns({"tr": number("at_row"), "tc": number("at_col")})
    # how many lots a tile needs
    key = ["scene_id", "tr", "tc"]
    lots = q.groupBy(*key).agg(F.ceil(F.count("*") / together).cast("int").alias("lots"))
    q = q.join(lots, key).withColumn("lot", F.pmod(F.xxhash64("row", "col"), F.col("lots")).cast("int")).drop("lots")
    spans = lambda c: F.sequence(F.floor((F.col(c) - behind) / tile).cast("int"), F.floor((F.col(c) + before) / tile).cast("int"))
    p = raster.select("scene_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(v).cast("double").alias(v) for v in values])
    p = p.withColumn("tr", F.explode(spans("row"))).withColumn("tc", F.explode(spans("col")))
    p = p.join(lots, key).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    names = ["scene_id", "row", "col", "at_row", "at_col"]
    schema = q.select(*names).schema
    for v in values:
        schema = schema.add(f"_{v}", "double")
    size = tile + before + behind

    def gather(key: tuple, places: pa.Table, pixels: pa.Table) -> pa.Table:
        tr, tc = (key[i].as_py() for i in (1, 2))
        top, left = tr * tile - before, tc * tile - before
        r, c = (pixels.column(n).to_numpy() for n in ("row", "col"))
        y, x = (places.column(n).to_numpy() for n in ("at_row", "at_col"))
        i, j = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        wy, wx = _weights(kernel, y - i), _weights(kernel, x - j)
        weight = wy[:, :, None] * wx[:, None, :]
        taps = np.arange(before + behind + 1)
        rows, cols = (i - top - before)[:, None] + taps, (j - left - before)[:, None] + taps
        out = []
        for v in values:
            field = np.full((size, size), np.nan)
            field[r - top, c - left] = pixels.column(v).to_numpy(zero_copy_only=False)
            near = field[rows[:, :, None], cols[:, None, :]]
            got = np.where(weight != 0, near * weight, 0).sum((1, 2))
            out.append(pa.array(got, from_pandas=True))
        return pa.Table.from_arrays([*[places.column(n) for n in names], *out], names=[*names, *[f"_{v}" for v in values]])

    keys = [*key, "lot"]
    fresh = lambda df: df.select(*[(F.col(c) + 0 if c in ("scene_id", "row", "col") else F.col(c)).alias(c) for c in df.columns])  # noqa: E731  columns of their own, as the requests may be made of the raster
    found = fresh(q).groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(gather, schema)
    rest = asked.filter(~F.coalesce(fine, F.lit(False))).select(*names, *[F.lit(None).cast("double").alias(f"_{v}") for v in values])
    return found.unionByName(rest).withColumnsRenamed({f"_{v}": v for v in values})


def moved(raster: DataFrame, field_row: Column, field_col: Column, values: Sequence[str] = ("v",), kernel: str = "cubic", **how) -> DataFrame:
    """The raster at each of its places moved by a field of offsets (columns of row and col), on its own grid."""
    at = raster.select("scene_id", "row", "col", (F.col("row") + field_row).alias("at_row"), (F.col("col") + field_col).alias("at_col"))
    return resampled(raster, at, values, kernel, **how).select("scene_id", "row", "col", *values)


def geometry_offsets(points: DataFrame, frames: DataFrame, vectors: DataFrame, pair: str = "scene_id") -> DataFrame:
    """(pair, point, row, col, d_row, d_col): where ground points (pair, point, lat, lon, height) lie in the reference, and how much farther in the secondary.

    ``frames`` has for each pair, and side "reference" and "secondary": orbit, first_time, row_s, near_range, col_m and center_time, a guess of when the
    scene is seen. Points that an orbit does not see near then are left out.
    """
    at = ecef(F.col("lat"), F.col("lon"), F.col("height"))
    p = points.select(pair, "point", at["x"].alias("px"), at["y"].alias("py"), at["z"].alias("pz"))
    both = p.join(frames, pair)
    seen = zero_doppler(both, vectors, "orbit", "time", "center_time")
    seen = seen.withColumns({"_row": (F.col("zero_time") - F.col("first_time")) / F.col("row_s"), "_col": (F.col("zero_time_range") - F.col("near_range")) / F.col("col_m")})
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = seen.groupBy(pair, "point").agg(*[of(s, c).alias(f"{s[0]}{c}") for s in ("reference", "secondary") for c in ("_row", "_col")])
    return out.filter("r_row IS NOT NULL AND s_row IS NOT NULL").select(pair, "point", F.col("r_row").alias("row"), F.col("r_col").alias("col"), (F.col("s_row") - F.col("r_row")).alias("d_row"), (F.col("s_col") - F.col("r_col")).alias("d_col"))


MODES = ("geometry", "geometry and constant", "geometry and plane")
FIELD = "scene_id long, row_terms array<double>, col_terms array<double>, mode string, n_geometry long, n_measured long, n_used long, rms double"


def _terms(row: np.ndarray, col: np.ndarray, degree: int) -> np.ndarray:
    return np.stack([row ** (n - k) * col**k for n in range(degree + 1) for k in range(n + 1)], 1)


def _solved(row: np.ndarray, col: np.ndarray, off: np.ndarray, degree: int) -> np.ndarray:
    a = _terms(row, col, degree)
    scale = np.abs(a).max(0)
    scale[scale == 0] = 1
    return np.linalg.lstsq(a / scale, off, rcond=None)[0] / scale


def _first_geometry(b: pd.DataFrame, degree: int, plane: int, constant: int, limit: float, floor: float, rounds: int) -> dict | None:
    g, m = b[~b["measured"]], b[b["measured"]]
    count = lambda d: (d + 1) * (d + 2) // 2
    while degree > 1 and len(g) < count(degree):
        degree -= 1
    if len(g) < count(degree):
        return None
    at = {k: tuple(x[c].to_numpy(float) for c in ("row", "col", "d_row", "d_col")) for k, x in (("g", g), ("m", m))}
    found = [_solved(at["g"][0], at["g"][1], at["g"][2 + i], degree) for i in range(2)]
    row, col, *off = at["m"]
    rest = np.stack([o - _terms(row, col, degree) @ f for o, f in zip(off, found)]) if len(m) else np.zeros((2, 0))
    keep = np.ones(len(m), bool)
    for _ in range(rounds):
        if keep.sum() <= constant:
            break
        far = np.hypot(*(rest - np.median(rest[:, keep], 1, keepdims=True)))
        middle = np.median(far[keep])
        bad = keep & (far > middle + limit * max(1.4826 * np.median(np.abs(far[keep] - middle)), floor))
        if not bad.any() or (keep & ~bad).sum() < constant:
            break
        keep &= ~bad
    used, mode = int(keep.sum()), 0
    if used >= plane:
        more, mode = [_solved(row[keep], col[keep], r[keep], 1) for r in rest], 2
    elif used >= constant:
        more, mode = [np.array([np.median(r[keep])]) for r in rest], 1
    if mode:
        for f, x in zip(found, more):
            f[: len(x)] += x
    rms = float(np.hypot(*[(_terms(row, col, degree) @ f - o)[keep] for f, o in zip(found, off)]).mean()) if used else 0.0
    return {"row_terms": found[0].tolist(), "col_terms": found[1].tolist(), "mode": MODES[mode], "n_geometry": len(g), "n_measured": len(m), "n_used": used, "rms": rms}


def geometry_first(points: DataFrame, degree: int = 1, plane: int = 8, constant: int = 2, limit: float = 3.0, floor: float = 0.05, rounds: int = 2) -> DataFrame:
    """For each scene the field of offsets through its geometry's points, corrected by what the measured ones support.

    ``points``: (scene_id, measured, row, col, d_row, d_col). With ``plane`` measured points that agree the correction is a plane, with ``constant``
    their median, else none; points whose distance from the median correction is off are left out. Terms are those of 1, row, col, row^2,
    row col, col^2 and so on, of a lower degree where there are too few points; a scene with fewer than a plane needs has no row.
    """

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        b = b.dropna(subset=["row", "col", "d_row", "d_col", "measured"]).astype({"measured": bool})
        found = _first_geometry(b, degree, plane, constant, limit, floor, rounds) if len(b) else None
        return pd.DataFrame([{"scene_id": b["scene_id"].iloc[0], **found}] if found else [], columns=[f.split()[0] for f in FIELD.split(", ")])

    return points.select("scene_id", "measured", "row", "col", "d_row", "d_col").groupBy("scene_id").applyInPandas(fit, FIELD)


def offset_at(terms: str, row: Column, col: Column, degree: int = 1) -> Column:
    """The value of a field's terms at a place; terms that it lacks are 0."""
    powers = [(n - k, k) for n in range(degree + 1) for k in range(n + 1)]
    return sum((F.coalesce(F.try_element_at(terms, F.lit(i + 1)), F.lit(0.0)) * F.pow(row, F.lit(a)) * F.pow(col, F.lit(b)) for i, (a, b) in enumerate(powers)), F.lit(0.0))


def terrain_heights(pixels: DataFrame, dem: DataFrame, lat0: float, lon0: float, step: float, places, rounds: int = 3) -> DataFrame:
    """``pixels`` (scene_id, row, col) with ``height``: the elevation where each lies on its own range and time.

    ``places(pixels, height)`` gives pixels with lat and lon at a height (``geolocation.locate`` does); the ``dem`` (scene_id, row, col, v) has its first
    pixel at lat0, lon0 and ``step`` degrees between pixels, to the south and east. Heights settle in a few ``rounds``, from 0 on; null off the dem.
    """
    now = pixels.withColumn("height", F.lit(0.0))
    for _ in range(rounds):  # each round's places are kept, as the gather reads them several times
        at = kept(places(now, F.col("height")).select("scene_id", "row", "col", ((lat0 - F.col("lat")) / step).alias("at_row"), ((F.col("lon") - lon0) / step).alias("at_col")))
        found = resampled(dem, at, kernel="linear").select("scene_id", "row", "col", F.col("v").alias("height"))
        now = pixels.join(found, ["scene_id", "row", "col"], "left")
    return now


REFINED = "scene_id long, point long, d_row double, d_col double, coherence double"


def _chip(field: np.ndarray, top: float, left: float, size: int) -> np.ndarray:
    """``size`` x ``size`` values from a fractional place on, between pixels linear."""
    i, j = int(np.floor(top)), int(np.floor(left))
    u, v = top - i, left - j
    part = field[i : i + size + 1, j : j + size + 1]
    part = part[:-1] * (1 - u) + part[1:] * u if u else part[:size]
    return part[:, :-1] * (1 - v) + part[:, 1:] * v if v else part[:, :size]


def _agreement(a: np.ndarray, b: np.ndarray) -> float:
    power = (np.abs(a) ** 2).sum() * (np.abs(b) ** 2).sum()
    return float(np.abs((a * np.conj(b)).sum()) / np.sqrt(power)) if power > 0 else 0.0


def _most_alike(ref: np.ndarray, sec: np.ndarray, top: float, left: float, window: int, coarse: int, fine: float) -> tuple[float, float, float]:
    """(rows, columns, coherence) of the shift of ``sec`` that is most coherent with ``ref``: whole pixels first, then ever finer grids around the best."""
    at = lambda r, c: _agreement(ref, _chip(sec, top + r, left + c, window))
    whole = range(-coarse, coarse + 1)
    best = max(((at(r, c), -abs(r) - abs(c), r, c) for r in whole for c in whole))
    value, _, r0, c0 = best
    r, c, step = float(r0), float(c0), fine / 2
    while step > 1e-4:
        grid = [(at(y, x), -abs(y - r) - abs(x - c), y, x) for y in r + step * np.arange(-2, 3) for x in c + step * np.arange(-2, 3) if abs(y - r0) <= fine and abs(x - c0) <= fine]
        value, _, r, c = max(grid)
        step /= 2
    return r, c, value


def refined_by_coherence(points: DataFrame, ref: DataFrame, sec: DataFrame, window: int = 32, coarse: int = 4, fine: float = 1.5, least: float = 0.3, tile: int = 256) -> DataFrame:
    """(scene_id, point, d_row, d_col, coherence) of control points (scene_id, point, row, col, d_row, d_col) whose offsets a search in the images mends.

    ``ref`` and ``sec``: (scene_id, row, col, re, im), without burst ramps (``ramps.turned`` takes them off). A window around the reference
    place is compared with windows around the offset one, at most ``coarse`` pixels and a further ``fine`` away, between pixels linear.
    Points that are less coherent than ``least``, or whose windows are not all known, are left out. A point takes
    (window + 2 (coarse + fine))^2 pixels of each image to a task; pixels meet points by an equality join on tiles.
    """
    if window % 2:
        window += 1
    half, margin = window // 2, int(np.ceil(coarse + fine)) + 1
    p = points.select(F.col("scene_id").cast("long").alias("scene_id"), F.col("point").cast("long").alias("point"), *[F.col(c).cast("double").alias(c) for c in ("row", "col", "d_row", "d_col")]).dropna()
    sides = []
    for image, name, r, c, more in ((ref, "ref", F.col("row"), F.col("col"), 1), (sec, "sec", F.col("row") + F.col("d_row"), F.col("col") + F.col("d_col"), margin)):
        a = p.select("scene_id", "point", r.alias("_r"), c.alias("_c"), *[(F.floor(x) + s * (half + more)).cast("long").alias(n) for x, n, s in ((r, "r0", -1), (r, "r1", 1), (c, "c0", -1), (c, "c1", 1))])
        for n, t in (("r", "tr"), ("c", "tc")):
            a = a.withColumn(t, F.explode(F.sequence(F.floor(F.col(f"{n}0") / tile), F.floor(F.col(f"{n}1") / tile))))
        x = image.select(F.col("scene_id").cast("long").alias("scene_id"), F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"), F.col("row").cast("long").alias("_y"), F.col("col").cast("long").alias("_x"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
        near = a.join(x, ["scene_id", "tr", "tc"]).filter("_y BETWEEN r0 AND r1 AND _x BETWEEN c0 AND c1")
        sides.append(near.select("scene_id", "point", F.lit(name).alias("side"), (F.col("_y") - F.col("r0")).cast("int").alias("i"), (F.col("_x") - F.col("c0")).cast("int").alias("j"), (F.col("_r") - F.col("r0")).alias("y"), (F.col("_c") - F.col("c0")).alias("x"), "re", "im"))

    def search(t: pa.Table) -> pa.Table:
        b = t.to_pandas()
        fields, places = {}, {}
        for name, more in (("ref", 1), ("sec", margin)):
            s = b[b["side"] == name]
            size = 2 * (half + more) + 1
            fields[name] = np.full((size, size), np.nan + 0j)
            fields[name][s["i"], s["j"]] = s["re"] + 1j * s["im"]
            places[name] = (s["y"].iloc[0] - half, s["x"].iloc[0] - half) if len(s) else (0.0, 0.0)
        found: dict[str, list] = {f.split()[0]: [] for f in REFINED.split(", ")}
        if all(np.isfinite(f).all() for f in fields.values()):
            r, c, value = _most_alike(_chip(fields["ref"], *places["ref"], window), fields["sec"], *places["sec"], window, coarse, fine)
            if value >= least:
                found = dict(zip(found, ([int(b["scene_id"][0])], [int(b["point"][0])], [r], [c], [value])))
        kinds = pa.schema([("scene_id", pa.int64()), ("point", pa.int64()), *[(n, pa.float64()) for n in ("d_row", "d_col", "coherence")]])
        return pa.table(found, schema=kinds)

    found = sides[0].unionByName(sides[1]).groupBy("scene_id", "point").applyInArrow(search, REFINED)
    moved_by = p.select("scene_id", "point", F.col("d_row").alias("_dr"), F.col("d_col").alias("_dc"))
    return found.join(moved_by, ["scene_id", "point"]).select("scene_id", "point", (F.col("_dr") + F.col("d_row")).alias("d_row"), (F.col("_dc") + F.col("d_col")).alias("d_col"), "coherence")
