"""Queries of stacks: inversion, scatterers, risk, comparisons, percentiles, components."""

from __future__ import annotations

from math import pi, radians, sin

from pyspark.sql import functions as F

from ..operators import detect, inversion, resampling, series
from ..sources import sinks
from ..sources import tables as t
from .base import BANDS, PIXELS, add, r6, sr

_c = F.col
_LEVELS = "(SELECT l_partkey AS pixel, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, avg(l_extendedprice) / 1e5 AS p, avg(l_discount) AS c FROM lineitem GROUP BY ALL)"
_IFG = f"(SELECT a.pixel, a.day AS d1, b.day AS d2, b.p - a.p AS phase, 0.3 + a.c * 5 / (b.i - a.i) AS coherence FROM (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY day) AS i FROM {_LEVELS}) a JOIN (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY day) AS i FROM {_LEVELS}) b ON a.pixel = b.pixel AND b.i - a.i BETWEEN 1 AND 3)"
_VEL = "regr_slope(p * 0.05546576 / (4 * pi()), day / 365.25)"
add("sbas_wls", f"SELECT v.pixel, {sr('velocity')} AS velocity, 0.0 AS rms, n, n_dates FROM (SELECT pixel, {_VEL} AS velocity, count(*) AS n_dates FROM {_LEVELS} GROUP BY pixel) v JOIN (SELECT pixel, count(*) AS n FROM {_IFG} GROUP BY pixel) i ON v.pixel = i.pixel")(
    lambda s, d: inversion.invert(t.interferograms(s, d)).select("pixel", r6(_c("velocity")).alias("velocity"), r6(_c("rms")).alias("rms"), "n", "n_dates")
)
_good = f"(SELECT * FROM {_IFG} WHERE coherence >= 0.32)"
_ENDS = f"(SELECT pixel, d1 AS day FROM {_good} UNION SELECT pixel, d2 FROM {_good})"
add("sbas_usable_pixels", f"SELECT e.pixel, n, n_dates FROM (SELECT pixel, count(*) AS n_dates FROM {_ENDS} GROUP BY pixel) e JOIN (SELECT pixel, count(*) AS n FROM {_good} GROUP BY pixel) i ON e.pixel = i.pixel WHERE n >= n_dates - 1")(lambda s, d: inversion.invert(t.interferograms(s, d), least_coherence=0.32).select("pixel", "n", "n_dates"))
add("sbas_bridge_penalty", None)(lambda s, d: inversion.invert(t.interferograms(s, d).withColumn("bridge", _c("coherence") < 0.35).withColumn("phase", _c("phase") + F.sin(_c("d1") * 7 + _c("d2"))), bridge_penalty=0.3))
add("phase_closures", f"SELECT x.pixel, x.d1 AS a, x.d2 AS b, y.d2 AS c, {sr('x.phase + y.phase - z.phase')} AS closure FROM {_IFG} x JOIN {_IFG} y ON x.pixel = y.pixel AND x.d2 = y.d1 JOIN {_IFG} z ON z.pixel = x.pixel AND z.d1 = x.d1 AND z.d2 = y.d2")(
    lambda s, d: inversion.closures(t.interferograms(s, d)).select("pixel", "a", "b", "c", r6(_c("closure")).alias("closure"))
)
_BEST = f"(SELECT arg_min(pixel, (-round(m, 12), pixel)) AS pixel FROM (SELECT pixel, avg(coherence) AS m FROM {_IFG} GROUP BY pixel))"
add("reference_pixel_pairs", f"SELECT i.pixel, i.d1, i.d2, {sr('1000 * (i.phase - coalesce(r.phase, 0))')} AS phase FROM {_IFG} i LEFT JOIN (SELECT d1, d2, phase FROM {_IFG} WHERE pixel = (SELECT pixel FROM {_BEST})) r ON i.d1 = r.d1 AND i.d2 = r.d2")(
    lambda s, d: inversion.referenced(t.interferograms(s, d).withColumn("coherence", F.round("coherence", 15))).select("pixel", "d1", "d2", r6(1000 * _c("phase")).alias("phase"))
)
add("dem_error", f"SELECT pixel, {sr('sum(coherence * coherence * b * phase) / nullif(sum(coherence * coherence * b * b), 0)')} AS beta FROM (SELECT *, CAST((d1 + d2) % 401 - 200 AS DOUBLE) AS b FROM {_IFG}) WHERE abs(b) > 10 AND coherence > 0.3 GROUP BY pixel")(
    lambda s, d: inversion.dem_error(t.interferograms(s, d).withColumn("baseline", ((_c("d1") + _c("d2")) % 401 - 200).cast("double")).withColumn("residual", _c("phase"))).withColumn("beta", r6(_c("beta")))
)

_AMP = f"(SELECT scene_id, row, col, abs(v) + 0.5 AS v FROM {PIXELS})"
_DISP = f"(SELECT row, col, stddev_pop(v) / (avg(v) + 1e-6) AS adi, avg(v) AS amplitude FROM {_AMP} GROUP BY row, col)"
_amp = lambda s, d: t.rasters(s, d).withColumn("v", F.abs("v") + 0.5)
_PS = f"(SELECT row, col, adi < 0.5 AND amplitude > (SELECT quantile_cont(amplitude, 0.3) FROM {_DISP}) AS ps FROM {_DISP})"
add("persistent_scatterers", f"SELECT * FROM {_PS}")(lambda s, d: series.scatterers(_amp(s, d), threshold=0.5, share=0.3).select("row", "col", "ps"))
_GAM = f"(SELECT row, col, sqrt(pow(avg(cos(v * 0.01 * 4 * pi() / 0.05546576)), 2) + pow(avg(sin(v * 0.01 * 4 * pi() / 0.05546576)), 2)) AS gamma FROM {PIXELS} GROUP BY row, col)"
add("refined_scatterers", f"SELECT p.row, p.col, ps AND gamma >= 0.2 AS ps FROM {_PS} p JOIN {_GAM} g ON p.row = g.row AND p.col = g.col")(
    lambda s, d: series.refined(series.scatterers(_amp(s, d), threshold=0.5, share=0.3), t.rasters(s, d).withColumn("v", _c("v") * 0.01), least=0.2).select("row", "col", "ps")
)
_SEL = f"(SELECT 'all' AS name, row * 8 + col AS key, true AS picked, amplitude AS quality FROM {_DISP} UNION ALL SELECT 'steady', row * 8 + col, adi < 0.5, amplitude FROM {_DISP} UNION ALL SELECT 'bright', row * 8 + col, amplitude > 1.2, amplitude FROM {_DISP})"


def _selections(s, d):
    x = series.dispersion(_amp(s, d)).withColumn("key", _c("row") * 8 + _c("col"))
    return x.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), p.alias("picked")) for n, p in (("all", F.lit(True)), ("steady", _c("adi") < 0.5), ("bright", _c("amplitude") > 1.2))])).alias("x"), "key", _c("amplitude").alias("quality")).select("x.*", "key", "quality")


add("compare_selections", f"SELECT s.name, count(CASE WHEN s.picked THEN 1 END) AS n, {sr('count(CASE WHEN s.picked THEN 1 END) / count(*)')} AS share, {sr('avg(CASE WHEN s.picked THEN s.quality END)')} AS mean, {sr('median(CASE WHEN s.picked THEN s.quality END)')} AS median, count(CASE WHEN s.picked AND NOT b.picked THEN 1 END) AS added, count(CASE WHEN NOT s.picked AND b.picked THEN 1 END) AS dropped FROM {_SEL} s JOIN {_SEL} b ON b.name = 'steady' AND b.key = s.key GROUP BY s.name")(
    lambda s, d: series.compared_selections(_selections(s, d), "steady").withColumns({c: r6(_c(c)) for c in ("share", "mean", "median")})
)
_MAP = lambda m: f"(SELECT scene_id, row, col, v FROM {PIXELS} WHERE (scene_id + row) % {m} > 0)"
add("compare_velocity_maps", f"SELECT count(CASE WHEN a IS NULL AND b IS NOT NULL THEN 1 END) AS gained, count(CASE WHEN a IS NOT NULL AND b IS NULL THEN 1 END) AS lost, count(b - a) AS common, {sr('median(b - a)')} AS median_off, {sr('quantile_cont(abs(b - a), 0.95)')} AS p95_off FROM (SELECT x.v AS a, y.v * 1.1 AS b FROM {_MAP(5)} x FULL JOIN {_MAP(7)} y USING (scene_id, row, col))")(
    lambda s, d: series.compared_maps(t.rasters(s, d).filter("(scene_id + row) % 5 > 0"), t.rasters(s, d).filter("(scene_id + row) % 7 > 0").withColumn("v", _c("v") * 1.1), ["scene_id", "row", "col"]).withColumns({c: r6(_c(c)) for c in ("median_off", "p95_off")})
)
_TY = "(date_diff('day', DATE '1990-01-01', date) / 365.25)"
_ty = lambda: F.datediff("date", F.lit("1990-01-01").cast("date")) / 365.25
_series = lambda s, d: t.bands(s, d).select("l_partkey", "date", (_c("dn") / 1e4).alias("v"))
_RISK = f"(SELECT l_partkey, CASE WHEN count(v) > 2 THEN coalesce(abs(regr_slope(v, {_TY})), NULL) ELSE 0 END / (stddev_pop(v) + 1e-10) AS risk, 1.959963984540054 * stddev_pop(v) / sqrt(count(*)) AS half FROM (SELECT l_partkey, date, dn / 1e4 AS v FROM {BANDS}) GROUP BY l_partkey)"
add("trend_risk", f"SELECT l_partkey, {sr('risk')} AS risk, {sr('risk - half')} AS lo, {sr('risk + half')} AS hi FROM {_RISK}")(lambda s, d: series.trend_risk(_series(s, d), ["l_partkey"], _ty()).withColumns({c: r6(_c(c)) for c in ("risk", "lo", "hi")}))
_NOISE = "greatest(1e-12, syy - b * sxy) / nullif(n - 2, 0)"
add("slope_posterior", f"SELECT l_partkey, CASE WHEN n > 2 THEN {sr(f'(4 * 0.1 + sxx / ({_NOISE}) * b) / (4 + sxx / ({_NOISE}))')} END AS mean, CASE WHEN n > 2 THEN {sr(f'1 / sqrt(4 + sxx / ({_NOISE}))')} END AS std FROM (SELECT l_partkey, regr_slope(v, {_TY}) AS b, regr_sxx(v, {_TY}) AS sxx, regr_syy(v, {_TY}) AS syy, regr_sxy(v, {_TY}) AS sxy, regr_count(v, {_TY}) AS n FROM (SELECT l_partkey, date, dn / 1e4 AS v FROM {BANDS}) GROUP BY l_partkey)")(
    lambda s, d: series.slope_posterior(_series(s, d), ["l_partkey"], _ty(), 0.1, 0.5).withColumns({c: r6(_c(c)) for c in ("mean", "std")})
)
_TRUTH = f"(SELECT *, risk * 0.9 + half * 0.5 AS truth, risk - half AS lo, risk + half AS hi FROM {_RISK} WHERE risk IS NOT NULL)"
add("risk_map_validation", f"SELECT {sr('sqrt(avg((risk - truth) * (risk - truth)))')} AS rmse, {sr('avg(abs(risk - truth))')} AS mae, {sr('1 - sum((risk - truth) * (risk - truth)) / nullif(var_pop(truth) * count(truth), 0)')} AS r2, {sr('avg(CASE WHEN truth BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)')} AS coverage, {sr('avg(hi - lo)')} AS sharpness FROM {_TRUTH}")(
    lambda s, d: series.checked_risk(series.trend_risk(_series(s, d), ["l_partkey"], _ty()).filter("risk IS NOT NULL").withColumn("truth", _c("risk") * 0.9 + (_c("hi") - _c("lo")) / 4)).select(*[r6(_c(c)).alias(c) for c in ("rmse", "mae", "r2", "coverage", "sharpness")])
)
_TWO = f"(SELECT row, col, scene_id, CASE WHEN scene_id % 3 > 0 THEN v END AS a, CASE WHEN (scene_id + col) % 4 > 0 THEN v * 2 END AS b FROM {PIXELS})"
add("composite_best_pixel", f"SELECT row, col, scene_id, {sr('a')} AS a, {sr('b')} AS b FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY -(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT)), scene_id) AS r FROM {_TWO}) WHERE r = 1")(
    lambda s, d: series.best_pixels(t.rasters(s, d).select("row", "col", "scene_id", F.when(_c("scene_id") % 3 > 0, _c("v")).alias("a"), F.when((_c("scene_id") + _c("col")) % 4 > 0, _c("v") * 2).alias("b")), ["a", "b"]).select("row", "col", "scene_id", r6(_c("a")).alias("a"), r6(_c("b")).alias("b"))
)
_SRC = lambda i: f"(SELECT scene_id - {i} AS scene_id, row, col, CASE WHEN abs(v) < 1 THEN v END AS v FROM {PIXELS})"
_src = lambda s, d, i: t.rasters(s, d).select((_c("scene_id") - i).alias("scene_id"), "row", "col", F.when(F.abs("v") < 1, _c("v")).alias("v"))
add("cloud_fill_series", f"SELECT x.scene_id, x.row, x.col, {sr('coalesce(x.v, y.v, z.v)')} AS v FROM {_SRC(0)} x LEFT JOIN {_SRC(1)} y USING (scene_id, row, col) LEFT JOIN {_SRC(2)} z USING (scene_id, row, col)")(lambda s, d: series.cloud_filled(_src(s, d, 0), [_src(s, d, 1), _src(s, d, 2)], ["scene_id", "row", "col"]).withColumn("v", r6(_c("v"))))
_ZP = f"(SELECT CAST((row // 4) * 2 + col // 4 AS INT) AS zone, v FROM {PIXELS})"
_zp = lambda s, d: t.rasters(s, d).select((F.floor(_c("row") / 4) * 2 + F.floor(_c("col") / 4)).cast("int").alias("zone"), "v")
add("zonal_majority", f"SELECT zone, arg_min(whole, (-n, whole)) AS majority FROM (SELECT zone, CAST(trunc(v * 3) AS BIGINT) AS whole, count(*) AS n FROM {_ZP} GROUP BY ALL) GROUP BY zone")(lambda s, d: series.majority(_zp(s, d).withColumn("v", _c("v") * 3), "zone"))
add("zonal_percentiles", " UNION ALL ".join(f"SELECT zone, CAST({q} AS DOUBLE) AS share, {sr(f'quantile_cont(v, {q})')} AS value FROM {_ZP} GROUP BY zone" for q in (0.05, 0.5, 0.9)))(lambda s, d: series.zone_percentiles(_zp(s, d), "zone", (0.05, 0.5, 0.9)).withColumn("value", r6(_c("value"))))
add("zone_series_map", f"SELECT l_partkey % 25 AS zone, count(*) AS n, {sr('avg(m)')} AS mean FROM (SELECT l_partkey, l_partkey % 25 AS z, year(date) AS y, avg(dn) AS m FROM (SELECT l_partkey % 25 AS l_partkey, date, dn FROM {BANDS}) GROUP BY ALL) GROUP BY 1")(
    lambda s, d: series.zone_series(t.bands(s, d).groupBy((_c("l_partkey") % 25).alias("zone"), F.year("date").alias("y")).agg(F.avg("dn").alias("m")), "zone", "y", "m").select("zone", F.size("series").cast("long").alias("n"), r6(F.aggregate(F.map_values("series"), F.lit(0.0), lambda a, x: a + x) / F.size("series")).alias("mean"))
)
add("reliable_reference_pixel", f"SELECT row, col, {sr('reliable')} AS reliable FROM (SELECT row, col, avg(CASE WHEN v > -0.5 THEN 1.0 ELSE 0.0 END) AS reliable, avg(abs(v)) AS coherence FROM {PIXELS} GROUP BY row, col) ORDER BY reliable DESC, coherence DESC, row, col LIMIT 1")(
    lambda s, d: series.reliable_pixel(t.rasters(s, d).select("row", "col", (_c("v") > -0.5).alias("ok"), F.abs("v").alias("coherence"))).select("row", "col", r6(_c("reliable")).alias("reliable"))
)
_SF = lambda e: "(" + " UNION ALL ".join(f"SELECT {n} AS lag, avg(d * d) AS q FROM (SELECT {e} - lag({e}, {n}) OVER (PARTITION BY scene_id, row ORDER BY col) AS d FROM {PIXELS})" for n in (1, 2, 4)) + ")"
add("variance_reduction", f"SELECT a.lag, {sr('1 - b.q / a.q')} AS reduction FROM {_SF('v')} a JOIN {_SF('(v * 0.5 + col * 0.1)')} b ON a.lag = b.lag")(
    lambda s, d: series.variance_reduction(detect.structure_function(t.rasters(s, d)), detect.structure_function(t.rasters(s, d).withColumn("v", _c("v") * 0.5 + _c("col") * 0.1))).withColumn("reduction", r6(_c("reduction")))
)
add("tie_components_mode", f"SELECT component, arg_min(cycles, (-k, cycles)) AS cycles FROM (SELECT CAST(scene_id % 50 AS BIGINT) AS component, CAST(round_even(v * 0.4, 0) AS BIGINT) AS cycles, count(*) AS k FROM {PIXELS} WHERE row > 0 AND scene_id % 50 > 0 GROUP BY ALL) GROUP BY component HAVING sum(k) >= 200 AND max(k) >= 0.5 * sum(k)")(
    lambda s, d: series.tied_components(t.rasters(s, d).select((_c("scene_id") % 50).alias("component"), (_c("row") > 0).alias("trusted"), F.lit(0.0).alias("classical"), (_c("v") * 0.4).alias("learned")))
)
_PC = ("blue", "green", "red", "nir")
add("pca_bands", None)(lambda s, d: series.principal_components(t.bands(s, d).select("l_orderkey", "l_linenumber", *_PC), _PC, 3))


@add("pca_variance", f"SELECT {sr('var_samp(blue) + var_samp(green) + var_samp(red) + var_samp(nir)')} AS total, 0.0 AS shared FROM {BANDS}")
def pca_variance(s, d):
    """All components have the bands' whole variance and share none."""
    p = series.principal_components(t.bands(s, d).select(*_PC), _PC, 4)
    return p.agg(r6(sum((F.var_samp(f"pc{i}") for i in (2, 3, 4)), F.var_samp("pc1"))).alias("total"), r6(F.abs(F.covar_samp("pc1", "pc2")) + F.abs(F.covar_samp("pc2", "pc3"))).alias("shared"))
# without noise each replicate is the series itself; the bootstrap's draws are no SQL's
add("risk_monte_carlo_quiet", f"SELECT l_partkey, {sr('risk')} AS risk, 0.0::DOUBLE AS std FROM (SELECT l_partkey, CASE WHEN count(v) > 2 THEN coalesce(abs(regr_slope(v, {_TY})), 0) ELSE 0 END / (stddev_pop(v) + 1e-10) AS risk FROM (SELECT l_partkey, date, dn / 1e4 AS v FROM {BANDS}) GROUP BY l_partkey)")(
    lambda s, d: resampling.drawn_risk(_series(s, d), ["l_partkey"], _ty(), "monte_carlo", replicates=3, noise=0.0).select("l_partkey", r6(_c("risk")).alias("risk"), r6(_c("std")).alias("std"))
)
add("risk_bootstrap", None)(lambda s, d: resampling.drawn_risk(_series(s, d), ["l_partkey"], _ty(), replicates=200))

# heights and motions planted in networks whose pairs have baselines of their own
_SCALE = "(800000.0 * sin(radians(39)))"
_BASE = "CAST((d1 * 7 + d2 * 13) % 11 - 5 AS DOUBLE) * 20"
_HEIGHT = "(pixel % 41 - 20)"
_base = lambda: ((_c("d1") * 7 + _c("d2") * 13) % 11 - 5).cast("double") * 20


def _lifted(s, d, motion=None):
    """Networks with the phase of a height; instead of their own displacements, of a steady ``motion``."""
    ifg = t.interferograms(s, d).withColumn("baseline", _base())
    own = _c("phase") if motion is None else motion * (_c("d2") - _c("d1")) / 365.25 * (4 * pi / inversion.WAVELENGTH_M)
    return ifg.withColumn("phase", own + _c("baseline") / (800000.0 * sin(radians(39))) * (_c("pixel") % 41 - 20) * (4 * pi / inversion.WAVELENGTH_M))


_TURNS = f"(SELECT DISTINCT x.pixel FROM {_IFG} x JOIN {_IFG} y ON x.pixel = y.pixel AND x.d2 = y.d1 JOIN {_IFG} z ON z.pixel = x.pixel AND z.d1 = x.d1 AND z.d2 = y.d2 WHERE {_BASE.replace('d1', 'x.d1').replace('d2', 'x.d2')} + {_BASE.replace('d1', 'y.d1').replace('d2', 'y.d2')} <> {_BASE.replace('d1', 'z.d1').replace('d2', 'z.d2')})"
add("sbas_with_heights", f"SELECT i.pixel, CASE WHEN u.pixel IS NOT NULL THEN CAST({_HEIGHT.replace('pixel', 'i.pixel')} AS DOUBLE) + 0.0 END AS height, CASE WHEN u.pixel IS NOT NULL THEN {sr('velocity')} END AS velocity, n_dates FROM (SELECT pixel, {_VEL} AS velocity, count(*) AS n_dates FROM {_LEVELS} GROUP BY pixel HAVING count(*) > 1) i LEFT JOIN {_TURNS} u ON u.pixel = i.pixel")(
    lambda s, d: inversion.joint_series(_lifted(s, d), 800000.0, 39.0).select("pixel", r6(_c("height")).alias("height"), F.when(_c("height").isNotNull(), r6(_c("velocity"))).alias("velocity"), "n_dates")
)
_STEADY = f"(SELECT pixel, d2 - d1 AS t, {_BASE} AS b FROM {_IFG})"
add("steady_motion_with_heights", f"SELECT pixel, CASE WHEN ok THEN (pixel % 13 - 6) * 0.01 + 0.0 END AS velocity, CASE WHEN ok THEN CAST({_HEIGHT} AS DOUBLE) + 0.0 END AS height, n FROM (SELECT pixel, count(*) AS n, max(b / t) <> min(b / t) AND max(abs(b)) > 0 AS ok FROM {_STEADY} GROUP BY pixel)")(
    lambda s, d: inversion.joint_velocity(_lifted(s, d, (_c("pixel") % 13 - 6) * 0.01), 800000.0, 39.0).withColumns({c: r6(_c(c)) for c in ("velocity", "height")})
)

_HOLD = 20
_RATED = f"""(SELECT 'adi' AS name, row, col, -stddev_pop(v) / (avg(v) + 1e-6) AS score FROM (SELECT scene_id, row, col, abs(v) + 0.5 AS v FROM {PIXELS}) WHERE scene_id <= (SELECT max(vec_id) - {_HOLD} FROM embeddings) GROUP BY row, col
 UNION ALL SELECT 'random', row, col, CAST(('0x' || substr(md5('0:' || row || ':' || col), 1, 8)) AS BIGINT) FROM (SELECT DISTINCT row, col FROM {PIXELS}))"""
_TOP = f"(SELECT name, row, col FROM (SELECT *, rank() OVER (PARTITION BY name ORDER BY score DESC) AS k FROM {_RATED}) WHERE k <= 12)"
_UNIT = f"(SELECT scene_id, row, col, cos(v * 10) AS re, sin(v * 10) AS im FROM {PIXELS})"
_OFF = f"(SELECT scene_id, row, col, atan2(im, re) - atan2(ni, nr) AS a FROM (SELECT a.scene_id, a.row, a.col, any_value(a.re) AS re, any_value(a.im) AS im, sum(b.re) - any_value(a.re) AS nr, sum(b.im) - any_value(a.im) AS ni FROM {_UNIT} a JOIN {_UNIT} b ON a.scene_id = b.scene_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.scene_id, a.row, a.col))"
_GAMMA = f"(SELECT row, col, CASE WHEN scene_id <= (SELECT max(vec_id) - {_HOLD} FROM embeddings) THEN 0 ELSE 1 END AS side, sqrt(avg(cos(a)) * avg(cos(a)) + avg(sin(a)) * avg(sin(a))) AS gamma FROM {_OFF} GROUP BY ALL)"
_HELD = f"(SELECT p.name, count(*) AS n, avg(i.gamma) AS in_sample, avg(o.gamma) AS held_out FROM {_TOP} p JOIN {_GAMMA} i ON i.row = p.row AND i.col = p.col AND i.side = 0 JOIN {_GAMMA} o ON o.row = p.row AND o.col = p.col AND o.side = 1 GROUP BY p.name)"
add("holdout_stability", f"SELECT h.name, n, {sr('in_sample')} AS in_sample, {sr('held_out')} AS held_out, {sr('coalesce(k, 0) / n / (n / 8.0)')} AS neighbour_ratio, {sr('held_out - (SELECT held_out FROM held WHERE name = ' + chr(39) + 'random' + chr(39) + ')')} AS held_out_minus_random FROM held h LEFT JOIN (SELECT a.name, count(*) AS k FROM {_TOP} a JOIN {_TOP} b ON a.name = b.name AND greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1 GROUP BY a.name) e ON e.name = h.name".replace("SELECT h.name", f"WITH held AS MATERIALIZED {_HELD} SELECT h.name", 1))(
    lambda s, d: series.holdout(t.rasters(s, d).withColumn("phase", _c("v") * 10).withColumn("v", F.abs("v") + 0.5), n_eval=_HOLD, share=0.2, k=3).withColumns({c: r6(_c(c)) for c in ("in_sample", "held_out", "neighbour_ratio", "held_out_minus_random")})
)
add("selected_points", f"SELECT CAST(row + 0.5 AS DOUBLE) AS crop_row, CAST((col + 0.5) * 3 AS DOUBLE) AS crop_col, row AS stack_row, col AS stack_col, {sr('amplitude')} AS score, CAST(10 + 0.25 * (col + 0.5) AS DOUBLE) AS lon, CAST(50 - 0.25 * (row + 0.5) AS DOUBLE) AS lat FROM {_DISP} JOIN {_PS} USING (row, col) WHERE ps")(
    lambda s, d: sinks.selected_points(series.scatterers(_amp(s, d), threshold=0.5, share=0.3).select("row", "col", _c("ps").alias("picked"), r6(_c("amplitude")).alias("score")), transform=(0.25, 0.0, 10.0, 0.0, -0.25, 50.0))
)
