"""The azimuth phase ramp of burst images: its terms from annotation, its phase at a pixel, and the sign that the data carry.

Terms are a handful of rows a scene; a pixel meets them in one join on the scene and the ramp is a column expression.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIGHT = 299_792_458.0
#: Speed over the earth where a scene has no orbit vectors (m/s): a fixed value, it enters the steering rate alone.
SPEED = 7590.0


def polynomial(coefficients: Column, x: Column) -> Column:
    """sum of c_k x^k."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda total, c: total * x + c)


def burst_terms(swaths: DataFrame, bursts: DataFrame, polynomials: DataFrame, speeds: DataFrame | None = None) -> DataFrame:
    """(scene_id, lines, dt, tau0, rate, bursts): of each scene its bursts in order, as (mid, steering, fm, fm_t0, dc, dc_t0, center).

    ``swaths``: (scene_id, lines, samples, dt, tau0, rate, frequency, steering), seconds, hertz and radians a second; ``bursts``: (scene_id, burst,
    start); ``polynomials``: (scene_id, kind "fm" or "dc", time, t0, c), coefficients of two-way range time less t0, of which
    the nearest to a burst's middle in time counts, the earlier of equals; ``speeds``: (scene_id, time, speed), between
    which the speed is interpolated and beyond which it stays. A burst without both polynomials makes its scene null.
    """
    rows = bursts.select("scene_id", F.struct("burst", "start").alias("b"))
    rows = rows.unionByName(polynomials.select("scene_id", F.struct("kind", "time", "t0", "c").alias("p")), allowMissingColumns=True)
    if speeds is not None:
        rows = rows.unionByName(speeds.select("scene_id", F.struct("time", "speed").alias("v")), allowMissingColumns=True)
    lists = ["b", "p", *(["v"] if speeds is not None else [])]
    # a scene has some ten bursts and some tens of polynomials and speeds: all of a scene is one row, met by its swath in the only join
    j = rows.groupBy("scene_id").agg(*[F.collect_list(c).alias(c) for c in lists]).filter(F.size("b") > 0).join(swaths, "scene_id")

    def near(kind: str, mid: Column) -> Column:
        of = F.filter("p", lambda p: p["kind"] == kind)
        return F.array_min(F.transform(of, lambda p: F.struct(F.abs(p["time"] - mid).alias("away"), p["time"].alias("time"), p["t0"].alias("t0"), p["c"].alias("c"))))

    def met(one: Column) -> Column:
        mid = one["start"] + F.col("lines") * F.col("dt") / 2
        ends = [F.array_max(F.filter("v", lambda v: v["time"] <= mid)).alias("a"), F.array_min(F.filter("v", lambda v: v["time"] > mid)).alias("z")] if speeds is not None else []
        return F.struct(one["burst"].alias("burst"), mid.alias("mid"), near("fm", mid).alias("fm"), near("dc", mid).alias("dc"), *ends)

    def term(one: Column) -> Column:
        speed = F.lit(SPEED)
        if speeds is not None:
            a, z = one["a"], one["z"]
            part = (one["mid"] - a["time"]) / (z["time"] - a["time"])
            speed = F.coalesce(a["speed"] + part * (z["speed"] - a["speed"]), a["speed"], z["speed"], speed)
        steering = 2 * speed * F.col("frequency") / LIGHT * F.col("steering")
        middle = F.col("tau0") + F.col("samples") / 2 / F.col("rate")
        fm, dc = one["fm"], one["dc"]
        center = -polynomial(dc["c"], middle - dc["t0"]) / polynomial(fm["c"], middle - fm["t0"])
        return F.struct(one["burst"].alias("burst"), one["mid"].alias("mid"), steering.alias("steering"), fm["c"].alias("fm"), fm["t0"].alias("fm_t0"), dc["c"].alias("dc"), dc["t0"].alias("dc_t0"), center.alias("center"))

    j = j.withColumn("b", F.transform("b", met))
    return j.select("scene_id", "lines", "dt", "tau0", "rate", F.array_sort(F.transform("b", term)).alias("bursts"))


def _with_terms(pixels: DataFrame, terms: DataFrame) -> DataFrame:
    j = pixels.join(terms, "scene_id")
    number = F.greatest(F.lit(0), F.least(F.floor(F.col("row") / F.col("lines")).cast("int"), F.size("bursts") - 1))
    return j.withColumn("_b", number).withColumn("_t", F.element_at("bursts", F.col("_b") + 1))


def _ramp() -> tuple[Column, Column, Column]:
    """(phase, Doppler centroid, Doppler rate) at a row and column of a scene with its terms."""
    tau = F.col("tau0") + F.col("col") / F.col("rate")
    fm, dc = polynomial(F.col("_t.fm"), tau - F.col("_t.fm_t0")), polynomial(F.col("_t.dc"), tau - F.col("_t.dc_t0"))
    rate = F.col("_t.steering") / (1 - F.col("_t.steering") / fm)
    eta = (F.col("row") - F.col("_b") * F.col("lines") - F.col("lines") / 2) * F.col("dt")
    d = eta - (-dc / fm - F.col("_t.center"))
    return pi * rate * d * d + 2 * pi * dc * d, dc + rate * d, rate


def with_ramp(pixels: DataFrame, terms: DataFrame, sign: float = 1.0) -> DataFrame:
    """``pixels`` (scene_id, row, col in the whole swath, fractions allowed) with ``ramp``, in radians, and ``doppler`` and ``doppler_rate``.

    Bursts lie below each other with all their lines; rows beyond the last burst take its terms. Scenes without terms have no rows.
    """
    ramp, doppler, rate = _ramp()
    return _with_terms(pixels, terms).select(*pixels.columns, (sign * ramp).alias("ramp"), doppler.alias("doppler"), rate.alias("doppler_rate"))


def turned(pixels: DataFrame, angle: Column, re: str = "re", im: str = "im") -> DataFrame:
    """``pixels`` whose complex values are turned by ``angle``: by less the ramp to take it off, by the ramp to put it back."""
    c, s = F.cos(angle), F.sin(angle)
    return pixels.withColumns({re: F.col(re) * c - F.col(im) * s, im: F.col(re) * s + F.col(im) * c})


def sign_scores(pixels: DataFrame, terms: DataFrame, least_lines: int = 64) -> DataFrame:
    """(scene_id, plus, minus, none, sign, clear): how well lines follow each other, of 1, with the ramp taken off in either sign or left on.

    ``pixels``: (scene_id, row, col, re, im). Lines count that are an eighth of a burst away from its ends, of bursts with
    at least ``least_lines`` of them in the data; the sign is the better one's, and clear if twice as good as the others.
    Scores are null without such a burst or without any power.
    """
    ramp, _, _ = _ramp()
    p = _with_terms(pixels, terms).withColumn("ramp", ramp)
    line = F.col("row") - F.col("_b") * F.col("lines")
    inner = p.filter((line >= F.col("lines") / 8) & (line < F.col("lines") * 7 / 8))
    w = W.partitionBy("scene_id", "_b", "col").orderBy("row")
    names = {"plus": -1.0, "minus": 1.0, "none": 0.0}
    z = {n: (F.col("re") * F.cos(k * F.col("ramp")) - F.col("im") * F.sin(k * F.col("ramp")), F.col("re") * F.sin(k * F.col("ramp")) + F.col("im") * F.cos(k * F.col("ramp"))) for n, k in names.items()}
    v = inner.select("scene_id", "_b", "col", "row", "lines", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_p"), *[c.alias(f"{n}_{i}") for n, cs in z.items() for i, c in enumerate(cs)])
    v = v.withColumns({"_next": F.lead("row").over(w), **{f"{n}_{i}n": F.lead(f"{n}_{i}").over(w) for n in names for i in (0, 1)}})
    follows = F.col("_next") == F.col("row") + 1
    part = lambda c: F.sum(F.when(follows, c))
    sums = [part(F.col(f"{n}_0n") * F.col(f"{n}_0") + F.col(f"{n}_1n") * F.col(f"{n}_1")).alias(f"{n}r") for n in names] + [part(F.col(f"{n}_1n") * F.col(f"{n}_0") - F.col(f"{n}_0n") * F.col(f"{n}_1")).alias(f"{n}i") for n in names]
    of = v.groupBy("scene_id", "_b").agg(*sums, F.sum("_p").alias("_p"), (F.max("row") - F.min("row") + 1).alias("_rows")).filter(F.col("_rows") >= least_lines * 3 / 4)
    a = of.groupBy("scene_id").agg(*[(F.hypot(F.sum(f"{n}r"), F.sum(f"{n}i")) / F.nullif(F.sum("_p"), F.lit(0.0))).alias(n) for n in names])
    out = pixels.select("scene_id").distinct().join(a, "scene_id", "left")
    better = F.greatest("plus", "minus")
    clear = better > 2 * F.greatest(F.col("none"), F.least("plus", "minus"), F.lit(1e-6))
    return out.select("scene_id", *names, F.when(F.col("plus") >= F.col("minus"), 1).when(F.col("plus").isNotNull(), -1).alias("sign"), clear.alias("clear"))
