"""Queries of radar geolocation over circular orbits made from the tables: the SQL bisects and uses closed forms instead."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import WAVELENGTH_M, WGS84_A, WGS84_B
from ..operators import geolocation as g
from ..sources import tables as t
from .base import add

_c = F.col
RADIUS, RATE, TILT = 7_071_000.0, 2 * pi / 5_920, 1.7104  # of the orbits: metres, radians a second, inclination


def _circle(k, time):
    """The state of orbit ``k``: nodes and phases a little apart."""
    turn, node = time * RATE + k * 0.0005, k * 0.00002
    e1 = [F.cos(node), F.sin(node), F.lit(0.0)]
    e2 = [-F.sin(node) * F.cos(F.lit(TILT)), F.cos(node) * F.cos(F.lit(TILT)), F.sin(F.lit(TILT))]
    out = {n: RADIUS * (F.cos(turn) * a + F.sin(turn) * b) for n, a, b in zip("xyz", e1, e2)}
    return out | {f"v{n}": RADIUS * RATE * (F.cos(turn) * b - F.sin(turn) * a) for n, a, b in zip("xyz", e1, e2)}


def _vectors(s, d) -> DataFrame:
    """Four orbits with a vector every two seconds, one a part."""
    v = t.read(s, d, "part").select((_c("p_partkey") % 4).alias("orbit"), (F.floor(_c("p_partkey") / 4) * 2.0).alias("time"))
    return v.withColumns(_circle(_c("orbit"), _c("time")))


def _pixels(s, d) -> DataFrame:
    """A pixel a part, well inside its orbit."""
    p = t.read(s, d, "part")
    return p.select("p_partkey", (_c("p_partkey") % 4).alias("orbit"), (F.floor(_c("p_partkey") / 4) * 1.5 + 10 + _c("p_size") * 0.01).alias("time"), (820_000.0 + _c("p_size") * 2_111.5).alias("range_m"), (_c("p_retailprice") / 4).alias("height"))


# SQL: columns orbit, time, range_m, height of ``of`` with the state, and the point by bisecting the look angle
def _located(of: str) -> str:
    turn, node = f"(time * {RATE} + orbit * 0.0005)", "(orbit * 0.00002)"
    e1 = [f"cos({node})", f"sin({node})", "0.0"]
    e2 = [f"(-sin({node}) * cos({TILT}))", f"(cos({node}) * cos({TILT}))", f"sin({TILT})"]
    state = ", ".join([f"{RADIUS} * (cos({turn}) * {a} + sin({turn}) * {b}) AS s{n}" for n, a, b in zip("xyz", e1, e2)] + [f"-cos({turn}) * {a} - sin({turn}) * {b} AS d{n}" for n, a, b in zip("xyz", e1, e2)] + [f"cos({turn}) * {b} - sin({turn}) * {a} AS w{n}" for n, a, b in zip("xyz", e1, e2)])
    side = ", ".join(f"w{a} * -d{b} - w{b} * -d{a} AS c{n}" for n, a, b in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))
    point = lambda n, at: f"(s{n} + range_m * (cos({at}) * d{n} + sin({at}) * c{n}))"
    mid = "((a[1] + a[2]) / 2)"
    over = f"(pow({point('x', mid)}, 2) + pow({point('y', mid)}, 2)) / pow({WGS84_A} + height, 2) + pow({point('z', mid)}, 2) / pow({WGS84_B} + height, 2) > 1"
    angle = f"list_reduce(list_prepend([CAST(0 AS DOUBLE), CAST(1.2 AS DOUBLE)], [[CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)] FOR i IN range(60)]), lambda a, b: CASE WHEN {over} THEN [a[1], {mid}] ELSE [{mid}, a[2]] END)[1]"
    return f"(SELECT *, {', '.join(f'{point(n, "look")} AS p{n}' for n in 'xyz')} FROM (SELECT *, {angle} AS look FROM (SELECT *, {side} FROM (SELECT *, {state} FROM {of}))))"


def _passed(orbit: str) -> tuple[str, str]:
    """The time at which a circle passes the point closest (near ``time``), and the distance then."""
    node = f"(({orbit}) * 0.00002)"
    along = f"atan2(px * -sin({node}) * cos({TILT}) + py * cos({node}) * cos({TILT}) + pz * sin({TILT}), px * cos({node}) + py * sin({node}))"
    when = f"(({along} - ({orbit}) * 0.0005 + 2 * pi() * round((time * {RATE} + ({orbit}) * 0.0005 - {along}) / (2 * pi()))) / {RATE})"
    at = f"(({when}) * {RATE} + ({orbit}) * 0.0005)"
    e1, e2 = [f"cos({node})", f"sin({node})", "0.0"], [f"(-sin({node}) * cos({TILT}))", f"(cos({node}) * cos({TILT}))", f"sin({TILT})"]
    far = "sqrt(" + " + ".join(f"pow(p{n} - {RADIUS} * (cos({at}) * {a} + sin({at}) * {b}), 2)" for n, a, b in zip("xyz", e1, e2)) + ")"
    return when, far


_PIXELS = "(SELECT p_partkey, p_partkey % 4 AS orbit, p_partkey // 4 * 1.5::DOUBLE + 10 + p_size * 0.01::DOUBLE AS time, 820000.0::DOUBLE + p_size * 2111.5::DOUBLE AS range_m, p_retailprice / 4 AS height FROM part)"
# pixels well before an orbit's end
_INSIDE = "WHERE time < (SELECT max(p_partkey) // 4 * 2 - 15 FROM part)"


def _inside(s, d) -> DataFrame:
    end = t.read(s, d, "part").agg((F.floor(F.max("p_partkey") / 4) * 2 - 15).alias("_end"))
    px = _pixels(s, d)
    return px.crossJoin(F.broadcast(end)).filter(_c("time") < _c("_end")).drop("_end")  # one row


def _points(s, d) -> DataFrame:
    return g.locate(_inside(s, d), _vectors(s, d), "orbit", "time", "range_m", _c("height"))


_E2 = 1 - (WGS84_B / WGS84_A) ** 2
# an outward normal's latitude on the ellipsoid with grown axes differs from the geodetic one, so compare earth-centred metres and longitude
add("radar_ground_points", f"SELECT p_partkey, round(px, 2) + 0.0 AS px, round(py, 2) + 0.0 AS py, round(pz, 2) + 0.0 AS pz, round(degrees(atan2(py, px)), 7) + 0.0 AS lon FROM {_located(f'(SELECT * FROM {_PIXELS} {_INSIDE})')}")(
    lambda s, d: _points(s, d).select("p_partkey", *[(F.round(n, 2) + F.lit(0.0)).alias(n) for n in ("px", "py", "pz")], (F.round("lon", 7) + F.lit(0.0)).alias("lon"))
)
# there and back: the pixel's own time and range
add("zero_doppler_round_trip", f"SELECT p_partkey, round(time, 4) + 0.0 AS zero_time, round(range_m, 2) + 0.0 AS zero_time_range FROM {_PIXELS} {_INSIDE}")(
    lambda s, d: g.zero_doppler(_points(s, d).withColumn("guess", _c("time") + 3.5), _vectors(s, d), "orbit", "time", "guess").select("p_partkey", *[(F.round(n, k) + F.lit(0.0)).alias(n) for n, k in (("zero_time", 4), ("zero_time_range", 2))])
)
_WHEN, _FAR = _passed("(orbit + 1) % 4")
add("zero_doppler_other_orbit", f"SELECT p_partkey, round({_WHEN}, 4) + 0.0 AS zero_time, round({_FAR}, 2) + 0.0 AS zero_time_range FROM {_located(f'(SELECT * FROM {_PIXELS} {_INSIDE})')}")(
    lambda s, d: g.zero_doppler(_points(s, d).withColumn("orbit", (_c("orbit") + 1) % 4), _vectors(s, d), "orbit", "time", "time").select("p_partkey", *[(F.round(n, k) + F.lit(0.0)).alias(n) for n, k in (("zero_time", 4), ("zero_time_range", 2))])
)

# a pair a supplier, whose frame has the lines shipped by the supplier as pixels
ROWS, COLS, ROW_S, COL_M = 2_000, 3_000, 0.002, 13.0


def _frames(s, d) -> DataFrame:
    k = _c("s_suppkey")
    return t.read(s, d, "supplier").select(k.alias("pair"), (k % 3).alias("reference"), (k % 3 + 1).alias("secondary"), F.lit(ROWS).alias("rows"), F.lit(COLS).alias("cols"), (k % 40 * 1.5 + 15.0).alias("first_time"), F.lit(ROW_S).alias("row_s"), (840_000.0 + k % 7 * 1_000).alias("near_range"), F.lit(COL_M).alias("col_m"), F.lit(0.0).alias("shift"))


def _frame_pixels(s, d) -> DataFrame:
    return t.read(s, d, "lineitem").filter("l_linenumber = 1").groupBy(_c("l_suppkey").alias("pair")).agg((F.min("l_orderkey") * 37 % ROWS).alias("row"), (F.max("l_orderkey") * 53 % COLS).alias("col"), F.round(F.min("l_extendedprice") / 500, 3).alias("height"))


_PAIR = f"(SELECT l_suppkey AS pair, l_suppkey % 3 AS orbit, min(l_orderkey) * 37 % {ROWS} AS row, max(l_orderkey) * 53 % {COLS} AS col, round(min(l_extendedprice) / 500, 3) AS terrain FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey)"
_IN_FRAME = f"(SELECT *, pair % 40 * 1.5::DOUBLE + 15 + row * {ROW_S}::DOUBLE AS time, 840000.0::DOUBLE + pair % 7 * 1000 + col * {COL_M}::DOUBLE AS range_m FROM {_PAIR})"


def _phase_sql(height: str, out: str, digits: int = 2) -> str:
    return f"SELECT pair, row, col, round(4 * pi() / {WAVELENGTH_M} * ({_passed('orbit + 1')[1]} - range_m), {digits}) + 0.0 AS {out} FROM {_located(f'(SELECT *, {height} AS height FROM {_IN_FRAME})')}"


def _dense(s, d) -> DataFrame:
    frames, vectors, pixels = _frames(s, d), _vectors(s, d), _frame_pixels(s, d)
    return g.at_pixels(pixels, g.geometry_nodes(frames, vectors, "pair", probe=200.0, pixels=pixels), frames, "pair")


add("flat_earth_phase", _phase_sql("CAST(0 AS DOUBLE)", "phase"))(lambda s, d: _dense(s, d).select("pair", "row", "col", (F.round(g.geometric_phase(F.lit(0.0)), 2) + F.lit(0.0)).alias("phase")))
add("topographic_phase_at_height", _phase_sql("terrain", "phase", 1))(lambda s, d: _dense(s, d).select("pair", "row", "col", (F.round(g.geometric_phase(_c("height")), 1) + F.lit(0.0)).alias("phase")))
