"""Radar geolocation: ground points of pixels, times of zero Doppler, and the phase that a pair's geometry makes.

All of it is columns and equality joins. A ground point has one unknown: at a given range in the plane of zero Doppler
it is the look angle that puts the point on the ellipsoid, by a fixed number of Newton steps. A time of zero Doppler is
a root on one piece of the orbit: pieces are polynomials through five vectors, made once a vector, and a point meets
only the pieces of its guess's time cell. The geometry of a pair is solved at the nodes of a coarse grid, and pixels take it
from the sixteen nodes around them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import WAVELENGTH_M, WGS84_A, WGS84_B, geodetic, wrapped

SPEED_OF_LIGHT = 299_792_458.0
STATE = ("x", "y", "z", "vx", "vy", "vz")
Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def _triple(c: Column, names: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    return [c[n] for n in names]


def _held(**columns: Column) -> Column:
    """A struct in an array of one, whose transform computes it once for all who use it."""
    return F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))


def _named(prefix: str, v: Vector) -> dict[str, Column]:
    return {f"{prefix}{n}": c for n, c in zip("xyz", v)}


def ground_point(state: dict[str, Column], range_m: Column, height: Column, side: Column | int = 1, steps: int = 8) -> Column:
    """A struct (x, y, z): where the ellipsoid, its axes grown by ``height``, lies at ``range_m`` and zero Doppler.

    ``side`` is 1 for a sensor that looks to the right of its velocity and -1 to the left. Null where the range does not
    reach the ground, is beyond the horizon, or anything is null.
    """
    s, v = [state[n] for n in ("x", "y", "z")], [state[n] for n in ("vx", "vy", "vz")]
    side = F.lit(side) if isinstance(side, int) else side
    first = _held(**_named("s", s), **_named("v", v), **_named("c", _cross(v, s)), r=range_m, h=height, side=side)

    def axes(at: Column) -> Column:
        """The plane of zero Doppler: ``d`` down and ``c`` to the side."""
        s, v, c = (_triple(at, [f"{k}{n}" for n in "xyz"]) for k in "svc")
        along = F.try_divide(dot(s, v), dot(v, v))
        d = [v_ * along - s_ for v_, s_ in zip(v, s)]
        one = lambda a, k=1: [F.try_divide(x * k, norm(a)) for x in a]
        return F.struct(*[x.alias(n) for n, x in {**_named("s", s), **_named("d", one(d)), **_named("c", one(c, at["side"]))}.items()], at["r"].alias("r"), norm(s).alias("far"), (F.lit(WGS84_A) + at["h"]).alias("a"), (F.lit(WGS84_B) + at["h"]).alias("b"))

    def solved(at: Column) -> Column:
        s, d, c = (_triple(at, [f"{k}{n}" for n in "xyz"]) for k in "sdc")
        r = at["r"]
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(at["far"] * at["far"] + r * r - at["a"] * at["a"], 2 * at["far"] * r))))
        q = lambda p, w: (p[0] * w[0] + p[1] * w[1]) / (at["a"] * at["a"]) + p[2] * w[2] / (at["b"] * at["b"])
        place = lambda t: [x + r * (F.cos(t) * y + F.sin(t) * z) for x, y, z in zip(s, d, c)]
        turn = lambda t: [r * (F.cos(t) * z - F.sin(t) * y) for y, z in zip(d, c)]

        def step(t: Column, _: Column) -> Column:
            now = F.transform(F.array(F.struct(*[x.alias(n) for n, x in {**_named("p", place(t)), **_named("w", turn(t))}.items()])), lambda m: F.try_divide(q(_triple(m, ["px", "py", "pz"]), _triple(m, ["px", "py", "pz"])) - 1, 2 * q(_triple(m, ["px", "py", "pz"]), _triple(m, ["wx", "wy", "wz"]))))
            return t - F.element_at(now, 1)

        t = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.greatest(angle, F.lit(1e-4)), step)
        end = F.transform(F.array(t), lambda t: F.struct(*[x.alias(n) for n, x in zip("xyz", place(t))], t.alias("t")))
        # the near side of the earth alone, where the look angle grows with range
        return F.transform(end, lambda p: F.when((F.abs(q(_triple(p), _triple(p)) - 1) < 1e-11) & (p["t"] > 0) & (dot(_triple(p), _minus(_triple(p), s)) < 0), F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))))

    return F.element_at(F.flatten(F.transform(F.transform(first, axes), solved)), 1)


def _part(rows: str, name: str) -> Column:
    return F.transform(rows, lambda x: x[name].cast("double"))


def _divided(name: str, k: int) -> Column:
    """Divided differences of order ``k`` from those of the order before, over the nodes u."""
    return F.transform(name, lambda x, i: F.when(i < k, x).otherwise((x - F.element_at(name, i)) / (F.element_at("u", i + 1) - F.element_at("u", i - k + 1))))


_SLOPES = tuple(f"d{n}" for n in STATE)


def _on_piece(piece: Column, at: Column) -> Column:
    """A struct of the state at ``at`` on a piece, and its slopes: Newton's form from the highest order down."""

    def down(now: Column, q: Column) -> Column:
        step = at - q["u"]
        return F.struct(*[(now[n] * step + q[n]).alias(n) for n in STATE], *[(now[d] * step + now[n]).alias(d) for d, n in zip(_SLOPES, STATE)])

    return F.aggregate(piece, F.struct(*[F.lit(0.0).alias(n) for n in (*STATE, *_SLOPES)]), down)


def _lots(vectors: DataFrame, key: str, halo: int, span: float = 1000.0, many: int = 512) -> DataFrame:
    """``vectors`` (key, t, ...) with ``_lot``: an orbit's vectors by rank in lots of ``many``, each with ``halo`` of those before and after, ``_own`` false.

    A rank is the count of the orbit's vectors in the spans of time before, and the place in its own span, so no task holds an orbit.
    """
    v = vectors.withColumn("_span", F.floor(F.col("t") / span).cast("long"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_span")) - F.col("_n")
    spans = v.groupBy(key, "_span").agg(F.count("*").alias("_n")).select(key, "_span", before.alias("_first"))
    v = v.join(spans.hint("merge"), [key, "_span"])
    v = v.withColumn("_rank", F.col("_first") + F.row_number().over(W.partitionBy(key, "_span").orderBy("t")) - 1)
    lot = lambda shift: F.floor((F.col("_rank") + shift) / many)
    v = v.withColumn("_lot", F.explode(F.sequence(lot(-halo), lot(halo))))
    return v.withColumn("_own", F.col("_lot") == lot(0)).drop("_span", "_first", "_rank")


def orbit_pieces(vectors: DataFrame, key: str, time: str, degree: int = 4) -> DataFrame:
    """(key, t, t0, t1, last, s0, s1, piece): the polynomial around each vector.

    It goes through the ``degree`` + 1 vectors around the nearest one (an orbit's first or last at its ends) and holds from half
    way to the vector before, t0, to half way to the next, t1. s0 and s1 are the states there, the same for the piece before and
    after; ``last`` tells an orbit's last piece. A piece lists Newton's coefficients of x, y, z, vx, vy, vz, the highest order first, and
    its nodes' times from t. Times are seconds; repeated times count once, vectors without a time are left out, and orbits with fewer
    vectors have no piece.
    """
    v = vectors.select(key, F.col(time).alias("t"), F.struct(F.col(time).alias("t"), *STATE).alias("_v")).filter(F.col("t").isNotNull() & ~F.isnan("t")).dropDuplicates([key, "t"])
    v = _lots(v, key, degree + 1)
    w = W.partitionBy(key, "_lot").orderBy("t")
    v = v.select(key, "_lot", "_own", "t", F.lag("t").over(w).alias("_before"), F.lead("t").over(w).alias("_after"), F.collect_list("_v").over(w.rowsBetween(-degree, degree)).alias("_near"))
    place = F.array_position(F.transform("_near", lambda x: x["t"]), F.col("t")).cast("int")
    first = F.greatest(F.lit(1), F.least(place - degree // 2, F.size("_near") - degree))
    v = v.withColumn("_near", F.slice("_near", first, degree + 1)).filter(F.size("_near") == degree + 1)
    v = v.withColumn("u", F.transform("_near", lambda x: x["t"] - F.col("t")))
    v = v.withColumns({n: _part("_near", n) for n in STATE})
    for k in range(1, degree + 1):
        v = v.withColumns({n: _divided(n, k) for n in STATE})
    half = lambda a: (F.col(a) + F.col("t")) / 2
    v = v.select(key, "_lot", "_own", "t", F.coalesce(half("_before"), F.col("t")).alias("t0"), F.coalesce(half("_after"), F.col("t")).alias("t1"), F.col("_after").isNull().alias("last"), F.reverse(F.arrays_zip("u", *STATE)).alias("piece"))
    state = lambda at: F.element_at(F.transform(F.array(_on_piece(F.col("piece"), F.col(at) - F.col("t"))), lambda s: F.struct(*[s[n].alias(n) for n in STATE])), 1)
    v = v.withColumn("s1", state("t1"))
    return v.withColumn("s0", F.coalesce(F.lag("s1").over(w), state("t0"))).filter("_own").drop("_lot", "_own")


def _cells(pieces: DataFrame, key: str, cell: float, reach: int) -> DataFrame:
    """The pieces under every time cell that they touch, or are within ``reach`` cells of."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    return pieces.withColumn("_cell", F.explode(F.sequence(at("t0") - reach, at("t1") + reach)))


def states(targets: DataFrame, vectors: DataFrame, key: str, time: str, target_time: str | None = None, cell: float = 10.0, degree: int = 4) -> DataFrame:
    """``targets`` with the state (x, y, z, vx, vy, vz) of orbit ``key`` at their time; null beyond the orbit's ends."""
    at = target_time or time
    p = _cells(orbit_pieces(vectors, key, time, degree), key, cell, 0).select(key, "_cell", "t0", "t1", F.col("last").alias("_ends"), F.struct("t", "piece").alias("_p"))
    now = F.col(f"a.{at}")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.floor(now / cell).cast("long") == F.col("b._cell")) & (now >= F.col("b.t0")) & ((now < F.col("b.t1")) | (F.col("b._ends") & (now == F.col("b.t1"))))
    joined = targets.alias("a").join(p.alias("b").hint("merge"), on, "left").select("a.*", "b._p")  # pieces are as many as vectors, and larger than Spark takes them for
    joined = joined.withColumn("_s", F.when(F.col("_p").isNotNull(), _on_piece(F.col("_p.piece"), F.col(at) - F.col("_p.t"))))
    return joined.select(*targets.columns, *[F.col(f"_s.{n}").alias(n) for n in STATE])


def zero_doppler(points: DataFrame, vectors: DataFrame, key: str, time: str, guess: str, point: Sequence[str] = ("px", "py", "pz"), out: str = "zero_time", cell: float = 10.0, reach: int = 2, degree: int = 4, steps: int = 8) -> DataFrame:
    """``points`` with ``out``, the time at which orbit ``key`` sees them at zero Doppler, and ``out``_range, the distance then.

    The pass is looked for within ``reach`` cells of ``cell`` seconds around the ``guess``, where Doppler falls through zero once.
    Null where it does not, or a point is null.
    """
    pieces = orbit_pieces(vectors, key, time, degree)
    ends = _cells(pieces, key, cell, reach).select(key, "_cell", "s0", "s1", F.col("t").alias("_t"))
    p = [F.col(f"a.{n}") for n in point]
    doppler = lambda end: dot(_triple(F.col(f"b.{end}"), ("vx", "vy", "vz")), _minus(p, _triple(F.col(f"b.{end}"))))
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.floor(F.col(f"a.{guess}") / cell).cast("long") == F.col("b._cell")) & (doppler("s0") > 0) & (doppler("s1") <= 0)
    joined = points.alias("a").join(ends.alias("b").hint("merge"), on, "left").select("a.*", "b._t")
    # the polynomial comes once the piece is known, so that the cells hold its ends alone
    joined = joined.join(pieces.select(F.col(key).alias("_key"), F.struct("t", "piece").alias("_p")).hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_t") == F.col("_p.t")), "left").drop("_key")
    flat = F.flatten(F.transform("_p.piece", lambda q: F.array(*[q[n] for n in ("u", *STATE)])))
    joined = joined.select(*points.columns, *[F.col(n).cast("double").alias(f"_{i}") for i, n in enumerate(point)], "_t", flat.alias("_q"))
    schema = points.schema
    for name in (out, f"{out}_range"):
        schema = schema.add(name, "double")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(batch.column("_q").is_valid().to_numpy(zero_copy_only=False))
            p = np.stack([batch.column(f"_{i}").take(pa.array(some)).to_numpy(zero_copy_only=False) for i in range(3)])
            q = batch.column("_q").take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), degree + 1, 1 + len(STATE))
            when, far = _passes(p, q, steps)
            made = np.full((2, len(batch)), np.nan)
            made[0, some], made[1, some] = batch.column("_t").take(pa.array(some)).to_numpy(zero_copy_only=False) + when, far
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-2]], *[pa.array(m, from_pandas=True) for m in made]], names=schema.names)

    return joined.mapInArrow(solve, schema)


def _passes(p: np.ndarray, q: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Times of zero Doppler from each piece's own, and the distances then: ``p`` is (3, points), ``q`` (points, orders, u and state)."""

    def state(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now, slope = np.zeros((len(STATE), len(u))), np.zeros((len(STATE), len(u)))
        for k in range(q.shape[1]):
            step = u - q[:, k, 0]
            now, slope = now * step + q[:, k, 1:].T, slope * step + now
        return now, slope

    product = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    u = np.zeros(len(q))
    with np.errstate(all="ignore"):
        for _ in range(steps):
            now, slope = state(u)
            away = p - now[:3]
            fall = product(slope[3:], away) - product(now[3:], slope[:3])
            u = u - product(now[3:], away) / np.where(fall == 0, np.nan, fall)
        away = p - state(u)[0][:3]
    return u, np.sqrt(product(away, away))


def locate(pixels: DataFrame, vectors: DataFrame, key: str, time: str, range_m: str, height: Column, side: int = 1, prefix: str = "p", **how) -> DataFrame:
    """``pixels`` (key, time, range_m) with the ground point (px, py, pz) and its lat and lon, on the orbit ``key``."""
    at = states(pixels.drop(*STATE), vectors, key, time, **how)
    at = at.withColumn("_g", ground_point({n: F.col(n) for n in STATE}, F.col(range_m), height, side))
    at = at.select(*[c for c in pixels.columns if c not in STATE], *[F.col(f"_g.{n}").alias(f"{prefix}{n}") for n in "xyz"])
    g = geodetic(*[F.col(f"{prefix}{n}") for n in "xyz"])
    return at.withColumns({"lat": g["lat"], "lon": g["lon"]})


NODE = ("phase_flat", "k1", "k2")


def geometry_nodes(frames: DataFrame, vectors: DataFrame, pair: str, nodes: tuple[int, int] = (9, 9), probe: float = 500.0, wavelength: float = WAVELENGTH_M, side: int = 1, pixels: DataFrame | None = None) -> DataFrame:
    """(pair, i, j, row, col, lat, lon, incidence, range_m, phase_flat, k1, k2): the geometry of each pair at its nodes.

    ``frames`` has for each pair (at most one row): reference and secondary (orbits' keys in ``vectors`` (orbit, time, state)), rows, cols,
    first_time, row_s (seconds a row), near_range, col_m (metres of range a column) and shift (seconds from the reference's pass to the
    secondary's). Nodes run one pixel beyond the frame on every side. The phase of a height h is phase_flat + k1 h + k2 h^2 / 2. Nodes
    that the orbits do not reach are null. With ``pixels`` (pair, row, col) only the nodes are solved that these take values from.
    """
    places = lambda n, size: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * (F.col(size) + 1) / (n - 1) - 1)
    grid = frames.select("*", F.posexplode(places(nodes[0], "rows")).alias("i", "row")).select("*", F.posexplode(places(nodes[1], "cols")).alias("j", "col"))
    if pixels is not None:
        four = lambda c, n: F.sequence(_first_node(F.col(c), n), _first_node(F.col(c), n) + 3)
        needed = _node_cells(pixels.select(pair, "row", "col"), frames, pair, nodes).select(pair, "_ci", "_cj").distinct()
        needed = needed.select(pair, F.explode(four("_ci", nodes[0])).alias("i"), "_cj").select(pair, "i", F.explode(four("_cj", nodes[1])).alias("j")).distinct()
        grid = grid.join(needed.hint("merge"), [pair, "i", "j"], "left_semi")
    grid = grid.select(pair, "i", "j", "row", "col", F.col("secondary"), F.col("reference").alias("orbit"), (F.col("first_time") + F.col("row") * F.col("row_s")).alias("time"), (F.col("near_range") + F.col("col") * F.col("col_m")).alias("range_m"), "shift")
    at = states(grid, vectors, "orbit", "time")
    state = {n: F.col(n) for n in STATE}
    at = at.select(*[c for c in at.columns if c != "orbit"], F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ground_point(state, F.col("range_m"), F.lit(k * probe), side).alias("p")) for k in range(3)])).alias("_e"))
    at = at.select(*[c for c in at.columns if c != "_e"], F.col("_e.k").alias("k"), *[F.col(f"_e.p.{n}").alias(f"p{n}") for n in "xyz"])
    seen = zero_doppler(at.withColumns({"orbit": F.col("secondary"), "_guess": F.col("time") + F.col("shift")}), vectors, "orbit", "time", "_guess")
    p, s = [F.col(f"p{n}") for n in "xyz"], [F.col(n) for n in "xyz"]
    seen = seen.withColumn("_phase", 4 * F.pi() / wavelength * (F.col("zero_time_range") - norm(_minus(p, s))))
    g = geodetic(*p)
    up = [F.cos(F.radians(F.col("lat"))) * F.cos(F.radians(F.col("lon"))), F.cos(F.radians(F.col("lat"))) * F.sin(F.radians(F.col("lon"))), F.sin(F.radians(F.col("lat")))]
    seen = seen.withColumns({"lat": g["lat"], "lon": g["lon"]}).withColumn("_look", F.degrees(F.acos(F.try_divide(dot(_minus(s, p), up), norm(_minus(s, p))))))
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = seen.groupBy(pair, "i", "j", "row", "col", "range_m").agg(pick("lat", 0).alias("lat"), pick("lon", 0).alias("lon"), pick("_look", 0).alias("incidence"), *[pick("_phase", k).alias(f"_{k}") for k in range(3)])
    k2 = (F.col("_2") - 2 * F.col("_1") + F.col("_0")) / (probe * probe)
    return out.select(pair, "i", "j", "row", "col", "lat", "lon", "incidence", "range_m", F.col("_0").alias("phase_flat"), ((F.col("_1") - F.col("_0")) / probe - k2 * probe / 2).alias("k1"), k2.alias("k2"))


def _first_node(cell: Column, n: int) -> Column:
    """The first of the four of ``n`` nodes that a cell between nodes takes values from."""
    return F.greatest(F.lit(0), F.least(cell - 1, F.lit(n - 4)))


def _node_cells(pixels: DataFrame, frames: DataFrame, pair: str, size: tuple[int, int]) -> DataFrame:
    """``pixels`` with _ci and _cj, the cell between nodes that each lies in."""
    steps = frames.select(pair, ((F.col("rows") + 1) / (size[0] - 1)).alias("_rs"), ((F.col("cols") + 1) / (size[1] - 1)).alias("_cs"))
    within = lambda c, n: F.least(F.floor(c).cast("int"), F.lit(n - 2))
    px = pixels.join(steps.hint("merge"), pair, "left")
    return px.withColumns({"_ci": within((F.col("row") + 1) / F.col("_rs"), size[0]), "_cj": within((F.col("col") + 1) / F.col("_cs"), size[1])})


def node_patches(nodes: DataFrame, pair: str, size: tuple[int, int] = (9, 9), values: Sequence[str] = NODE) -> DataFrame:
    """(pair, ci, cj, row, col, row_step, col_step, values): the 4 x 4 nodes that the cell ci, cj between nodes takes its values from, first ones' places and steps."""
    cells = nodes.select(pair, F.col("i").alias("_i"), F.col("j").alias("_j"), F.struct("i", "j", "row", "col", *values).alias("_n"))
    span = lambda c, n: F.filter(F.sequence(F.lit(0), F.lit(n - 2)), lambda x: (_first_node(x, n) <= F.col(c)) & (F.col(c) <= _first_node(x, n) + 3))
    cells = cells.withColumn("ci", F.explode(span("_i", size[0]))).withColumn("cj", F.explode(span("_j", size[1])))
    patch = cells.groupBy(pair, "ci", "cj").agg(F.array_sort(F.collect_list("_n")).alias("_p")).filter(F.size("_p") == 16)  # 16 nodes
    at = lambda k, n: F.element_at("_p", k)[n]
    return patch.select(pair, "ci", "cj", at(1, "row").alias("row"), at(1, "col").alias("col"), ((at(16, "row") - at(1, "row")) / 3).alias("row_step"), ((at(16, "col") - at(1, "col")) / 3).alias("col_step"), *[_part("_p", v).alias(v) for v in values])


def at_pixels(pixels: DataFrame, nodes: DataFrame, frames: DataFrame, pair: str, size: tuple[int, int] = (9, 9), values: Sequence[str] = NODE) -> DataFrame:
    """``pixels`` (pair, row, col) with the nodes' ``values`` there, cubic in rows and columns. One join on the cell between nodes; a pixel beyond the frame has nulls."""
    px = _node_cells(pixels, frames, pair, size)
    patch = node_patches(nodes, pair, size, values).select(F.col(pair).alias("_pair"), "ci", "cj", F.struct("row", "col", "row_step", "col_step", *values).alias("_p"))
    px = px.join(patch.hint("merge"), (F.col(pair) == F.col("_pair")) & (F.col("_ci") == F.col("ci")) & (F.col("_cj") == F.col("cj")), "left")

    def weights(u: Column) -> list[Column]:
        out = []
        for k in range(4):
            w = F.lit(1.0)
            for m in range(4):
                w = w if m == k else w * (u - m) / (k - m)
            out.append(w)
        return out

    px = px.withColumns({"_u": F.array(*weights((F.col("row") - F.col("_p.row")) / F.col("_p.row_step"))), "_w": F.array(*weights((F.col("col") - F.col("_p.col")) / F.col("_p.col_step")))})
    total = lambda v: sum((F.element_at("_u", a + 1) * F.element_at("_w", b + 1) * F.element_at(f"_p.{v}", 4 * a + b + 1) for a in range(4) for b in range(4)), F.lit(0.0))
    return px.select(*pixels.columns, *[total(v).alias(v) for v in values])


def geometric_phase(height: Column) -> Column:
    """The phase of the geometry at a terrain height, from phase_flat, k1 and k2; the flat-earth phase at height 0."""
    return F.col("phase_flat") + F.col("k1") * height + F.col("k2") * height * height / 2


def without_geometry(pixels: DataFrame, phase: Column, height: Column) -> DataFrame:
    """``pixels`` that have phase_flat, k1 and k2, with ``phase`` less the phase of the geometry, wrapped."""
    return pixels.withColumn("residual", wrapped(phase - geometric_phase(height)))
