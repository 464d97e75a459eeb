"""Stacks of dates: persistent scatterers, risk of trends, comparisons of selections and maps, composites, zone series."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import WAVELENGTH_M

CELL = ("row", "col")


def dispersion(stack: DataFrame, by: Sequence[str] = CELL, eps: float = 1e-6) -> DataFrame:
    """(by, adi, amplitude): relative spread and mean of a pixel's amplitudes ``v``."""
    return stack.groupBy(*by).agg((F.stddev_pop("v") / (F.avg("v") + eps)).alias("adi"), F.avg("v").alias("amplitude"))


def scatterers(stack: DataFrame, by: Sequence[str] = CELL, threshold: float = 0.25, share: float = 0.7) -> DataFrame:
    """``dispersion`` with ``ps``: steady pixels whose mean amplitude is above the given percentile of all."""
    d = dispersion(stack, by)
    bright = zone_percentiles(d.select(F.lit(0).alias("_z"), F.col("amplitude").alias("v")), "_z", [share]).select("_z", F.col("value").alias("_bright"))  # one row
    joined = d.withColumn("_z", F.lit(0)).join(F.broadcast(bright), "_z", "left")
    return joined.withColumn("ps", (F.col("adi") < threshold) & (F.col("amplitude") > F.col("_bright"))).drop("_bright", "_z")


def temporal_coherence(residuals: DataFrame, by: Sequence[str] = CELL, wavelength: float = WAVELENGTH_M) -> DataFrame:
    """(by, gamma): the length of the mean phasor of displacement residuals ``v``."""
    p = F.col("v") * (4 * pi / wavelength)
    return residuals.groupBy(*by).agg(F.sqrt(F.pow(F.avg(F.cos(p)), 2) + F.pow(F.avg(F.sin(p)), 2)).alias("gamma"))


def refined(selection: DataFrame, residuals: DataFrame, by: Sequence[str] = CELL, least: float = 0.7) -> DataFrame:
    """``selection`` whose ``ps`` must also be coherent in time."""
    g = temporal_coherence(residuals, by)
    return selection.join(g, list(by), "left").withColumn("ps", F.col("ps") & F.coalesce(F.col("gamma") >= least, F.lit(False)))


def compared_selections(selections: DataFrame, reference: str) -> DataFrame:
    """(name, n, share, mean, median, added, dropped) of selections (name, key, picked, quality) against one of them."""
    base = selections.filter((F.col("name") == reference) & F.col("picked")).select("key", F.lit(True).alias("_base"))
    j = selections.join(base, "key", "left").withColumn("_base", F.coalesce("_base", F.lit(False)))
    on = lambda c: F.when(F.col("picked"), c)
    counts = j.groupBy("name").agg(
        F.count(on(F.lit(1))).alias("n"), (F.count(on(F.lit(1))) / F.count("*")).alias("share"), F.avg(on(F.col("quality"))).alias("mean"),
        F.count(F.when(F.col("picked") & ~F.col("_base"), 1)).alias("added"), F.count(F.when(~F.col("picked") & F.col("_base"), 1)).alias("dropped"),
    )
    medians = zone_percentiles(selections.filter("picked").select("name", F.col("quality").alias("v")), "name", [0.5]).select(F.col("name").alias("_n"), F.col("value").alias("median"))
    return counts.join(medians, F.col("name").eqNullSafe(F.col("_n")), "left").select("name", "n", "share", "mean", "median", "added", "dropped")


def compared_maps(base: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row: pixels that a map gains, loses and shares, and the median and 95th percentile of what it is off there."""
    j = base.select(*by, F.col("v").alias("a")).join(new.select(*by, F.col("v").alias("b")), list(by), "full")
    d = F.col("b") - F.col("a")
    counts = j.agg(F.count(F.when(F.col("a").isNull() & F.col("b").isNotNull(), 1)).alias("gained"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNull(), 1)).alias("lost"), F.count(d).alias("common"))
    off = j.select(F.explode(F.array(F.struct(F.lit("median").alias("z"), d.alias("v")), F.struct(F.lit("far").alias("z"), F.abs(d).alias("v")))).alias("x")).select("x.z", "x.v")
    at = zone_percentiles(off, "z", [0.5, 0.95])
    pick = lambda z, share: F.max(F.when((F.col("z") == z) & (F.col("share") == share), F.col("value")))
    return counts.crossJoin(F.broadcast(at.agg(pick("median", 0.5).alias("median_off"), pick("far", 0.95).alias("p95_off"))))  # one row each


def trend_risk(series: DataFrame, by: Sequence[str], t: Column, z: float = 1.959963984540054) -> DataFrame:
    """(by, risk, lo, hi): the slope over the spread of ``v``, where more than two values are known, and its normal interval."""
    a = series.groupBy(*by).agg(F.regr_slope(F.col("v"), t).alias("_s"), F.stddev_pop("v").alias("_d"), F.count("v").alias("_n"), F.count("*").alias("_t"))
    risk = F.when(F.col("_n") > 2, F.abs("_s")).otherwise(0.0) / (F.col("_d") + 1e-10)
    half = z * F.col("_d") / F.sqrt("_t")
    return a.select(*by, risk.alias("risk"), (risk - half).alias("lo"), (risk + half).alias("hi"))


def slope_posterior(series: DataFrame, by: Sequence[str], t: Column, prior_mean: float = 0.0, prior_std: float = 1.0) -> DataFrame:
    """(by, mean, std): the normal posterior of a pixel's slope from its least-squares fit; null with fewer than three values."""
    y = F.col("v")
    a = series.groupBy(*by).agg(F.regr_slope(y, t).alias("_b"), F.regr_sxx(y, t).alias("_sxx"), F.regr_syy(y, t).alias("_syy"), F.regr_sxy(y, t).alias("_sxy"), F.regr_count(y, t).alias("_n"))
    noise = F.try_divide(F.greatest(F.lit(1e-12), F.col("_syy") - F.col("_b") * F.col("_sxy")), F.col("_n") - 2)
    own, prior = F.try_divide(F.col("_sxx"), noise), 1 / prior_std**2
    known = F.col("_n") > 2
    return a.select(*by, F.when(known, (prior * prior_mean + own * F.col("_b")) / (prior + own)).alias("mean"), F.when(known, 1 / F.sqrt(prior + own)).alias("std"))


def checked_risk(maps: DataFrame) -> DataFrame:
    """One row: rmse, mae, r2, coverage and sharpness of (risk, lo, hi) against ``truth``."""
    e, hit = F.col("risk") - F.col("truth"), (F.col("truth") >= F.col("lo")) & (F.col("truth") <= F.col("hi"))
    return maps.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop("truth") * F.count("truth"))).alias("r2"),
        F.avg(hit.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("sharpness"),
    )


def best_pixels(pixels: DataFrame, bands: Sequence[str], order: str = "scene_id", by: Sequence[str] = CELL) -> DataFrame:
    """Of each pixel's dates the bands of that with most known ones, the first of equals."""
    known = sum((F.col(b).isNotNull().cast("int") for b in bands[1:]), F.col(bands[0]).isNotNull().cast("int"))
    picked = F.min(F.struct((-known).alias("_k"), F.col(order), *bands)).alias("_p")
    return pixels.groupBy(*by).agg(picked).select(*by, F.col(f"_p.{order}").alias(order), *[F.col(f"_p.{b}").alias(b) for b in bands])


def cloud_filled(target: DataFrame, sources: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """``target`` whose missing values are those of the first source that knows them."""
    out, names = target, []
    for i, s in enumerate(sources):
        names.append(f"_v{i}")
        out = out.join(s.select(*by, F.col("v").alias(names[-1])), list(by), "left")
    return out.withColumn("v", F.coalesce("v", *names)).drop(*names)


def majority(pixels: DataFrame, zone: str) -> DataFrame:
    """(zone, majority): the most frequent whole part of ``v``, the smallest of equals."""
    n = pixels.filter("v IS NOT NULL").groupBy(zone, F.col("v").cast("long").alias("whole")).agg(F.count("*").alias("n"))
    return n.groupBy(zone).agg(F.min_by("whole", F.struct(-F.col("n"), F.col("whole"))).alias("majority"))


def zone_percentiles(pixels: DataFrame, zone: str, shares: Sequence[float], bins: int = 4096) -> DataFrame:
    """(zone, share, value): exact percentiles, a value's rank found by counts, so that no task holds a zone's values.

    Values are dealt to ``bins`` equal steps between their zone's ends; only the bins that hold a wanted rank are
    ranked value by value. Between two ranks the value is interpolated.
    """
    p = pixels.filter("v IS NOT NULL").select(zone, "v")
    ends = p.groupBy(zone).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("*").alias("_n"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    bin_ = F.least(F.lit(bins - 1), F.floor(F.coalesce((F.col("v") - F.col("_lo")) / width, F.lit(0.0)) * bins)).alias("_bin")
    binned = p.join(ends, zone).select(zone, "v", "_n", bin_)
    counts = binned.groupBy(zone, "_bin").agg(F.count("*").alias("_k"), F.max("_n").alias("_n"))
    order = W.partitionBy(zone).orderBy("_bin")
    counts = counts.withColumn("_ahead", F.sum("_k").over(order) - F.col("_k"))
    place = lambda s: F.lit(float(s)) * (F.col("_n") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), at.alias("rank"), part.alias("part")) for s in shares for at, part in ((F.floor(place(s)), 1 - (place(s) - F.floor(place(s)))), (F.floor(place(s)) + 1, place(s) - F.floor(place(s))))])).alias("q")
    asked = counts.select(zone, "_bin", "_ahead", "_k", wanted).select(zone, "_bin", "_ahead", "_k", "q.*").filter("part > 0 AND rank >= _ahead AND rank < _ahead + _k")
    # values of the bins asked for, equal ones as one
    values = binned.join(asked.select(zone, "_bin").distinct(), [zone, "_bin"], "left_semi").groupBy(zone, "_bin", "v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(zone, "_bin").orderBy("v"))
    ranked = values.withColumn("_upto", upto)
    hit = asked.join(ranked, [zone, "_bin"]).filter("rank - _ahead < _upto AND rank - _ahead >= _upto - _c")
    return hit.groupBy(zone, "share").agg(F.sum(F.col("v") * F.col("part")).alias("value"))


def zone_series(series: DataFrame, zone: str, date: str, value: str) -> DataFrame:
    """(zone, series): a map from date to value."""
    return series.groupBy(zone).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(date, value)))).alias("series"))


def reliable_pixel(stack: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """One row: the pixel that is reliable (``ok``) on most dates, of equals the most coherent, then the first."""
    a = stack.groupBy(*by).agg(F.avg(F.col("ok").cast("double")).alias("reliable"), F.avg("coherence").alias("coherence"))
    return a.orderBy(F.desc("reliable"), F.desc("coherence"), *by).limit(1)


def variance_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lag, reduction) from two structure functions (lag, rms)."""
    j = before.select("lag", F.col("rms").alias("_a")).join(after.select("lag", F.col("rms").alias("_b")), "lag")
    return j.select("lag", (1 - F.try_divide(F.col("_b") * F.col("_b"), F.col("_a") * F.col("_a"))).alias("reduction"))


def tied_components(pixels: DataFrame, least: int = 200, agreement: float = 0.5) -> DataFrame:
    """(component, cycles): the whole cycles between two solutions that most trusted pixels of a component agree on, where they do."""
    d = F.rint(F.col("learned") - F.col("classical")).cast("long")
    n = pixels.filter("trusted AND component > 0").groupBy("component", d.alias("cycles")).agg(F.count("*").alias("k"))
    a = n.groupBy("component").agg(F.sum("k").alias("all"), F.min(F.struct((-F.col("k")).alias("k"), "cycles")).alias("m"))
    return a.filter((F.col("all") >= least) & (-F.col("m.k") >= agreement * F.col("all"))).select("component", "m.cycles")


def principal_components(pixels: DataFrame, bands: Sequence[str], k: int) -> DataFrame:
    """``pixels`` with pc1 to pck: by the eigenvectors of the bands' covariance, whose sums Spark takes; the largest entry of each is positive.

    The driver gets one row of sums. Pixels with an unknown band have null components.
    """
    import numpy as np

    ok = F.greatest(*[F.col(b).isNull().cast("int") for b in bands]) == 0
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    row = pixels.filter(ok).agg(*[F.avg(b).alias(f"m{i}") for i, b in enumerate(bands)], *[F.covar_samp(bands[i], bands[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if row["m0"] is None:
        return pixels.withColumns({f"pc{i + 1}": F.lit(None).cast("double") for i in range(k)})
    cov = np.zeros((len(bands), len(bands)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    _, vectors = np.linalg.eigh(cov)
    out = {}
    for n in range(k):
        v = vectors[:, -1 - n]
        v = v * np.sign(v[np.abs(v).argmax()])
        terms = [(F.col(b) - row[f"m{i}"]) * float(v[i]) for i, b in enumerate(bands)]
        out[f"pc{n + 1}"] = F.when(ok, sum(terms[1:], terms[0]))
    return pixels.withColumns(out)


def top_share(scores: DataFrame, name: str, key: Sequence[str], share: float) -> DataFrame:
    """``scores`` (name, key..., score) with ``picked``: scores among the highest ``share`` of their name, equal ones at the edge included; null scores are the lowest."""
    low = scores.withColumn("v", F.coalesce("score", F.lit(-1e300)))
    edge = zone_ranks(low, name, share)
    return scores.join(edge, name).withColumn("picked", F.coalesce(F.col("score"), F.lit(-1e300)) >= F.col("_edge")).drop("_edge")


def zone_ranks(pixels: DataFrame, zone: str, share: float, bins: int = 4096) -> DataFrame:
    """(zone, _edge): the value of the last of the highest ``share`` of a zone's values, of one at least, without interpolation."""
    w = W.partitionBy(zone).orderBy(F.desc("_bin"))
    known = pixels.filter("v > -1e300")
    ends = pixels.groupBy(zone).agg(F.count("v").alias("_n")).join(known.groupBy(zone).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")), zone, "left")
    part = F.coalesce((F.col("v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    binned = pixels.join(ends, zone).select(zone, "v", F.greatest(F.lit(1), F.floor(F.col("_n") * share)).alias("_want"), F.when(F.col("v") > -1e300, F.least(F.lit(bins - 1), F.floor(part * bins))).otherwise(-1).alias("_bin"))
    counts = binned.groupBy(zone, "_bin").agg(F.count("*").alias("_k"), F.max("_want").alias("_want")).withColumn("_upto", F.sum("_k").over(w))
    hit = counts.filter("_upto >= _want AND _upto - _k < _want").select(zone, "_bin", (F.col("_upto") - F.col("_k")).alias("_ahead"))
    values = binned.join(hit, [zone, "_bin"]).groupBy(zone, "v").agg(F.count("*").alias("_c"), F.max("_ahead").alias("_ahead"), F.max("_want").alias("_want"))
    upto = values.withColumn("_upto", F.col("_ahead") + F.sum("_c").over(W.partitionBy(zone).orderBy(F.desc("v"))))
    return upto.filter("_upto >= _want AND _upto - _c < _want").select(zone, F.col("v").alias("_edge"))


def holdout_stability(stack: DataFrame, scores: DataFrame, coherence_in: DataFrame, coherence_out: DataFrame, share: float = 0.06, seed: int = 0) -> DataFrame:
    """(name, n, in_sample, held_out, neighbour_ratio, held_out_minus_random) of selections made without the last dates.

    ``stack``: (row, col) of all pixels; ``scores``: (name, row, col, score) from the other dates; coherences: (row, col, gamma) on
    those dates and on the ones held out. Each name picks its highest ``share``; 'random', by the hash of place and seed, is
    the baseline. neighbour_ratio: picked neighbours of a picked pixel over those expected of a random pick, null for none.
    """
    cells = stack.select("row", "col").distinct()
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "row", "col")), 1, 8), 16, 10).cast("long")
    all_scores = scores.select("name", "row", "col", "score").unionByName(cells.select(F.lit("random").alias("name"), "row", "col", drawn.cast("double").alias("score")))
    picked = top_share(all_scores, "name", ("row", "col"), share).filter("picked").select("name", "row", "col")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]))
    near = picked.withColumn("_o", around).select("name", (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"))
    near = near.join(picked, ["name", "row", "col"], "left_semi").groupBy("name").agg(F.count("*").alias("_near"))
    total = cells.agg(F.count("*").alias("_all"))  # one row
    p = picked.join(coherence_in.select("row", "col", F.col("gamma").alias("_in")), ["row", "col"], "left").join(coherence_out.select("row", "col", F.col("gamma").alias("_out")), ["row", "col"], "left")
    rows = p.groupBy("name").agg(F.count("*").alias("n"), F.avg("_in").alias("in_sample"), F.avg("_out").alias("held_out")).join(near, "name", "left").join(F.broadcast(total))
    rows = rows.withColumn("neighbour_ratio", F.coalesce("_near", F.lit(0)) / F.col("n") / (8 * F.col("n") / F.col("_all")))
    base = rows.filter("name = 'random'").select(F.col("held_out").alias("_random"))  # one row
    return rows.join(F.broadcast(base)).select("name", "n", "in_sample", "held_out", "neighbour_ratio", (F.col("held_out") - F.col("_random")).alias("held_out_minus_random"))


def holdout(stack: DataFrame, n_eval: int = 3, share: float = 0.06, k: int = 7, seed: int = 0) -> DataFrame:
    """``holdout_stability`` of amplitude dispersion over a stack (scene_id, row, col, v as amplitude, phase), the last ``n_eval`` scenes held out.

    Fewer than three scenes on either side give no rows. Numbers of scenes are counted first, one row.
    """
    from . import phase

    last = stack.select("scene_id").distinct().withColumn("_i", F.row_number().over(W.orderBy(F.desc("scene_id"))))  # scenes, not pixels
    sides = last.agg(F.count("*").alias("_n"), F.max(F.when(F.col("_i") == n_eval + 1, F.col("scene_id"))).alias("_cut")).filter((F.col("_n") - n_eval >= 3) & F.lit(n_eval >= 3))
    s = stack.join(F.broadcast(sides))
    kept, out = s.filter("scene_id <= _cut"), s.filter("scene_id > _cut")
    score = dispersion(kept).select(F.lit("adi").alias("name"), "row", "col", (-F.col("adi")).alias("score"))
    gamma = lambda x: phase.residual_coherence(x.select("scene_id", "row", "col", F.col("phase").alias("v")), k)
    return holdout_stability(s, score, gamma(kept), gamma(out), share, seed)
