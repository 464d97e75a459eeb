"""Queries of the radiometric column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import radiometry as rd
from ..operators import detect, raster
from ..sources import tables as t
from .base import BANDS, KEY, PAIRS, PIXELS, add, bands_query, pixel_query, r6, sr

_c = F.col

bands_query("idx_fei_ratio", lambda: {"fei": ix.fei()}, {"fei": "swir5 / nullif(red + 1e-10, 0) + nir1 / nullif(green + 1e-10, 0)"})
_NBR = lambda n, s, e="": f"({n} - {s}) / nullif({n} + {s}{e}, 0)"
bands_query("idx_dnbr_guarded", lambda: {"dnbr": ix.dnbr(_c("nir"), _c("swir2"), _c("nir1"), _c("swir1"))}, {"dnbr": f"{_NBR('nir', 'swir2')} - {_NBR('nir1', 'swir1')}"})
bands_query("idx_dnbr_eps", lambda: {"dnbr": ix.dnbr(_c("nir"), _c("swir2"), _c("nir1"), _c("swir1"), 1e-10)}, {"dnbr": f"{_NBR('nir', 'swir2', ' + 1e-10')} - {_NBR('nir1', 'swir1', ' + 1e-10')}"})
_T = "(1260.56 / ln(607.76 / (dn * 1.0 + 0.0) + 1))"
bands_query("lst_modis", lambda: {"lst": rd.land_surface_temperature(_c("dn"), "modis")}, {"lst": f"{_T} / (1 + 10.8e-6 * {_T} / 1.438e-2 * ln(0.97))"})
bands_query("landsat_thermal", lambda: {"kelvin": rd.landsat_scaled(_c("dn"), thermal=True)}, {"kelvin": "CASE WHEN dn <> 0 THEN dn * 0.00341802 + 149.0 END"})

_CLS = "CAST(l_partkey % 12 AS INT)"
_cls = lambda: (_c("l_partkey") % 12).cast("int")
_WHITE = "(abs(blue - m) + abs(green - m) + abs(red - m) + abs(nir - m)) / nullif(m, 0)"
bands_query(
    "cloud_mask_methods",
    lambda: {"scl": rd.cloudy("scl", [_cls()]), "fmask": rd.cloudy("fmask", [_c(b) * 10_000 for b in ("blue", "green", "red", "nir")]), "bright": rd.cloudy("threshold", [_c("green")]), "snow": rd.cloudy("ndsi", [_c("blue"), _c("green"), _c("red"), _c("swir1")])},
    {"scl": f"{_CLS} IN (3, 8, 9, 10, 11)", "fmask": f"(blue + green + red + nir) / 4 > 0.3 AND {_WHITE.replace('m)', '(blue + green + red + nir) / 4)').replace('nullif(m', 'nullif((blue + green + red + nir) / 4')} < 0.7", "bright": "green > 0.8", "snow": "(green - swir1) / nullif(green + swir1, 0) > 0.4"},
    whole=True,
)
bands_query("sen2cor_clip", lambda: {"reflectance": rd.atmosphere(_c("dn"), "sen2cor")}, {"reflectance": "greatest(0.0, least(1.0, dn / 10000))"})
_I = "(cos(radians(red * 300)) * 0.7071067811865476)"
bands_query(
    "topo_correct_slope",
    lambda: {"cosine": rd.topographic(_c("nir"), _c("red") * 300, "cosine"), "minnaert": rd.topographic(_c("nir"), _c("red") * 300, "minnaert"), "c": rd.topographic(_c("nir"), _c("red") * 300, "c", _c("green"))},
    {"cosine": f"nir * 0.7071067811865476 / greatest({_I}, 0.01)", "minnaert": f"nir * pow(0.7071067811865476 / greatest({_I}, 0.01), 0.5)", "c": f"nir * (0.7071067811865476 + green) / ({_I} + green)"},
)
_COSI = "(cos(radians(red * 300)) * cos(radians(40 + green * 20)) + sin(radians(red * 300)) * sin(radians(40 + green * 20)) * cos(radians(135.0 - swir1 * 300)))"
bands_query(
    "topo_correct_sun",
    lambda: {"corrected": rd.cosine_corrected(_c("nir"), _c("red") * 300, _c("swir1") * 300, 40 + _c("green") * 20, F.lit(135.0))},
    {"corrected": f"nir * cos(radians(40 + green * 20)) / greatest({_COSI}, 0.05)"},
)
_SUM = "(blue + green + red + nir)"
_SHARP = {"brovey": f"{{}} / ({_SUM} + 1e-10::DOUBLE) * swir1"} | {m: f"{{}} * CASE WHEN {o} > 0 THEN swir1 / ({o} + 1e-10::DOUBLE) ELSE 1 END" for m, o in (("ihs", "((blue + green + red) / 3)"), ("gram_schmidt", f"({_SUM} / 4)"), ("mean", f"({_SUM} / 4)"))}
for _m, _sql in _SHARP.items():  # as they are: ties of rounding would differ
    bands_query(f"pansharpen_{_m}", lambda m=_m: dict(zip(("blue_p", "green_p", "red_p", "nir_p"), rd.pansharpened(_c("swir1"), [_c(b) for b in ("blue", "green", "red", "nir")], m))), {f"{b}_p": _sql.format(b) for b in ("blue", "green", "red", "nir")}, whole=True)
_DB = "10 * log10(greatest(dn * dn * {}, 1e-10))"
bands_query("sar_calibrate_kinds", lambda: {k: rd.calibrated(_c("dn"), k) for k in ("sigma0", "gamma0", "beta0")}, {"sigma0": _DB.format("1.0"), "gamma0": _DB.format("cos(radians(38))"), "beta0": _DB.format("(1 / sin(radians(38)))")})
_LUT = "(dn * dn - swir2 * 1e8) / ((300 + green * 100) * (300 + green * 100))"
bands_query("grd_calibrate_lut", lambda: {"db": rd.calibrated(_c("dn"), lut=300 + _c("green") * 100, noise=_c("swir2") * 1e8)}, {"db": f"CASE WHEN {_LUT} > 0 THEN 10 * log10({_LUT}) END"})
bands_query("uq_phase_displacement", lambda: rd.phase_uncertainty(_c("red") * 12, 4), {"sigma_phase": (_s := "sqrt(1 - pow(greatest(1e-6, least(0.999999, red * 12)), 2)) / (greatest(1e-6, least(0.999999, red * 12)) * sqrt(8))"), "sigma_displacement": f"{_s} * 0.05546576 / (4 * pi())"})
_missing = lambda c, n: F.when(_c("l_linenumber") != n, c)
_W = "CASE WHEN i IS NULL AND NOT there THEN NULL WHEN NOT there THEN 1.0 WHEN i IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (red * 10 - 0.4::DOUBLE) / (0.6::DOUBLE - 0.4::DOUBLE))) END"
_FUSE = f"(SELECT *, {_W} AS w FROM (SELECT *, o IS NOT NULL AND green * 10 >= 1 AS there FROM (SELECT *, CASE WHEN l_linenumber <> 1 THEN swir1 END AS i, CASE WHEN l_linenumber <> 2 THEN swir2 END AS o FROM {BANDS})))"
add("fuse_insar_optical", f"SELECT l_orderkey, l_linenumber, {sr('w')} AS weight, {sr('1000 * CASE WHEN w IS NULL THEN NULL WHEN w >= 1 THEN i WHEN w <= 0 THEN o ELSE w * i + (1 - w) * o END')} AS fused, CASE WHEN w >= 1 THEN 2 WHEN w <= 0 THEN 0 ELSE 1 END AS source FROM {_FUSE}")(
    lambda s, d: t.bands(s, d).select("l_orderkey", "l_linenumber", *[(v if k == "source" else r6(1000 * v if k == "fused" else v)).alias(k) for k, v in rd.fused_velocity(_missing(_c("swir1"), 1), _c("red") * 10, _missing(_c("swir2"), 2), _c("green") * 10).items()])
)
_SC = ["least(100.0, 100 * abs(swir1) / 0.5)", "least(100.0, 100 * least(abs(red), 0.1) / 0.01)", "least(100.0, 100 * abs(nir * 0.01) / 0.001)"]
_MEAN = f"({' + '.join(_SC)}) / 3"
bands_query("geotechnical_risk", lambda: {"risk": rd.risk_index(_c("swir1"), _c("red"), _c("nir") * 0.01), "mean_risk": rd.risk_index(_c("swir1"), _c("red"), _c("nir") * 0.01, "mean")}, {"risk": f"0.6 * greatest({', '.join(_SC)}) + 0.4 * {_MEAN}", "mean_risk": _MEAN})
bands_query("stability_weights", lambda: {"weight": rd.stability_weight(_c("red") * 6)}, {"weight": "pow(1 - greatest(0.0, least(1.0, red * 6 / 0.4)), 2)"})

# two dates
_FLOOD = {"decrease": "a - b > 0.5", "increase": "a - b < -0.5", "both": "abs(a - b) > 0.5"}
add("flood_map", f"SELECT {KEY}, b < -1.0 AS below, {', '.join(f'{v} AS {k}' for k, v in _FLOOD.items())} FROM {PAIRS}")(
    lambda s, d: t.raster_pairs(s, d).select("scene_id", "row", "col", rd.flooded(_c("b"), -1.0).alias("below"), *[rd.flooded(_c("b"), -1.0, _c("a"), k).alias(k) for k in _FLOOD])
)
add("flood_share", f"SELECT scene_id, {sr('100.0 * count(CASE WHEN a - b > 0.5 THEN 1 END) / count(a - b)')} AS percent FROM {PAIRS} GROUP BY scene_id")(
    lambda s, d: t.raster_pairs(s, d).groupBy("scene_id").agg(r6(100.0 * F.count(F.when(rd.flooded(_c("b"), -1.0, _c("a")), 1)) / F.count(_c("a") - _c("b"))).alias("percent"))
)
add("multi_sensor_flood", f"SELECT {KEY}, valid, CASE WHEN valid THEN a > 0.2 ELSE b < -0.2 END AS aware, CASE WHEN valid THEN a > 0.2 OR b < -0.2 ELSE b < -0.2 END AS either FROM (SELECT *, NOT ((row * 8 + col) % 12 IN (3, 8, 9, 10)) AND NOT (a = 0 AND b = 0) AND a + b <> 0 AS valid FROM {PAIRS})")(
    lambda s, d: t.raster_pairs(s, d).withColumn("valid", rd.optical_valid((_c("row") * 8 + _c("col")) % 12, _c("a"), _c("b"))).select("scene_id", "row", "col", "valid", rd.fused_flood(_c("a") > 0.2, _c("b") < -0.2, _c("valid")).alias("aware"), rd.fused_flood(_c("a") > 0.2, _c("b") < -0.2, _c("valid"), "union").alias("either"))
)
add("vegetation_disturbance", f"SELECT scene_id, class, count(*) AS n FROM (SELECT scene_id, CASE WHEN a - b > 0.2 THEN 1 WHEN abs(a) < 0.3 THEN 2 ELSE 0 END AS class FROM {PAIRS}) GROUP BY ALL")(
    lambda s, d: t.raster_pairs(s, d).groupBy("scene_id", rd.disturbance(_c("a"), _c("b"), F.abs("a")).alias("class")).agg(F.count("*").alias("n"))
)
add("change_detection_db", f"SELECT scene_id, {sr('100.0 * count(CASE WHEN abs(b - a) > 1.0 THEN 1 END) / count(*)')} AS percent FROM {PAIRS} GROUP BY scene_id")(
    lambda s, d: t.raster_pairs(s, d).groupBy("scene_id").agg(r6(100.0 * F.count(F.when(rd.change_class(_c("a"), _c("b"), 1.0), 1)) / F.count("*")).alias("percent"))
)
_UQ = f"(SELECT scene_id, sqrt(1 - pow(greatest(1e-6, least(0.999999, abs(v))), 2)) / (greatest(1e-6, least(0.999999, abs(v))) * sqrt(8)) AS s FROM {PIXELS})"
add("uncertainty_summary", f"SELECT scene_id, {sr('avg(s)')} AS mean, {sr('median(s)')} AS median, {sr('quantile_cont(s, 0.95)')} AS p95 FROM {_UQ} GROUP BY scene_id")(
    lambda s, d: t.rasters(s, d).withColumn("s", rd.phase_uncertainty(F.abs("v"), 4)["sigma_phase"]).groupBy("scene_id").agg(r6(F.avg("s")).alias("mean"), r6(F.median("s")).alias("median"), r6(F.percentile("s", F.lit(0.95))).alias("p95"))
)
_POS = f"(SELECT scene_id, row, col, abs(v) + 0.1 AS v FROM {PIXELS})"
pixel_query("dos2", "out", f"SELECT p.*, CASE WHEN v > 0 THEN (v - dark) * 1.05 ELSE 0 END AS out FROM {_POS} p LEFT JOIN (SELECT scene_id, quantile_cont(v, 0.01) AS dark FROM {_POS} WHERE v > 0 GROUP BY scene_id) USING (scene_id)", lambda p: detect.subtract_dark(p.withColumn("v", F.abs("v") + 0.1), scale=1.05))
add("despeckle_frost", None)(lambda s, d: raster.despeckle(t.rasters(s, d).withColumn("v", F.abs("v") + 0.1), "frost", k=3))
