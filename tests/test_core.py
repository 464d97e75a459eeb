"""Core operators that SQL does not hold, against brute force, invariants and round trips."""

from __future__ import annotations

import itertools
import json
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolathe.operators import catalog, detect, hydrology, inversion, network, orbits, phase, preflight, raster, series, stencil, vectors
from geolathe.sources import products, sinks, stac
from geolathe.streaming import monitor


def _pixels(spark, arrays: dict[int, np.ndarray]):
    rows = [(k, int(r), int(c), None if np.isnan(v) else float(v)) for k, a in arrays.items() for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "scene_id long, row int, col int, v double").repartition(5)


def _back(df, column: str, shapes: dict[int, tuple]) -> dict[int, np.ndarray]:
    out = {k: np.full(s, np.nan) for k, s in shapes.items()}
    for r in df.select("scene_id", "row", "col", F.col(column).cast("double").alias("x")).collect():
        out[r["scene_id"]][r["row"], r["col"]] = np.nan if r["x"] is None else r["x"]
    return out


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(2)
    out = {1: rng.standard_normal((37, 23)), 2: rng.standard_normal((9, 50)), 3: rng.standard_normal((5, 5)), 4: rng.standard_normal((1, 7))}
    out[1][10:12, 4] = np.nan
    return out


def _shapes(arrays):
    return {k: a.shape for k, a in arrays.items()}


@pytest.mark.parametrize(("border", "mode"), [("mirror", {"mode": "symmetric"}), ("edge", {"mode": "edge"}), ("none", {"mode": "constant", "constant_values": np.nan})])
def test_tiles_give_what_whole_rasters_give(spark, arrays, border, mode):
    """Tiles of any size, thin ones and halos over several borders included."""
    k = 5
    got = _back(stencil.stencil(_pixels(spark, arrays), 2, lambda x: {"m": stencil.box_mean(x["v"], k)}, ["m"], border=border, tile=6), "m", _shapes(arrays))
    for key, a in arrays.items():
        want = stencil.box_mean(np.pad(a[None], ((0, 0), (2, 2), (2, 2)), **mode), k)[0]
        assert np.allclose(got[key], want, equal_nan=True)


def test_stencil_of_no_rows_and_many_small_rasters(spark):
    none = spark.createDataFrame([], "scene_id long, row int, col int, v double")
    assert raster.focal_mean(none).count() == 0
    many = spark.range(3000).select(F.col("id").alias("scene_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select("scene_id", F.floor(F.col("i") / 4).cast("int").alias("row"), (F.col("i") % 4).cast("int").alias("col"), (F.col("scene_id") + F.col("i")).cast("double").alias("v"))
    got = raster.focal_mean(many, 3).filter("row = 1 AND col = 1")
    assert got.count() == 3000 and got.filter("abs(mean - v) > 1e-9").count() == 0


def test_frost_against_numpy(spark):
    a = np.abs(np.random.default_rng(3).standard_normal((30, 20))) + 0.2
    got = _back(raster.despeckle(_pixels(spark, {7: a}), "frost", k=3), "out", {7: a.shape})[7]
    m, v = (x[0] for x in stencil.moments(np.pad(a[None], ((0, 0), (1, 1), (1, 1)), mode="symmetric"), 3))
    cv = np.sqrt(v) / (m + 1e-10)
    sigma = max(3 / (2 * (1 + cv.mean()) + 1e-10), 0.1)
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * np.arange(-r, r + 1) ** 2 / sigma**2)
    w /= w.sum()
    p = np.pad(a, r, mode="symmetric")
    smooth = np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), 1, np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), 0, p))
    assert np.allclose(got, np.exp(-cv * 3) * a + (1 - np.exp(-cv * 3)) * smooth)
    with pytest.raises(ValueError):
        raster.despeckle(_pixels(spark, {7: a}), "other")


def _levels(a: np.ndarray) -> np.ndarray:
    f = np.full(a.shape, np.inf)
    f[[0, -1]], f[:, [0, -1]] = a[[0, -1]], a[:, [0, -1]]
    while True:
        g = f.copy()
        for r, c in itertools.product(range(1, a.shape[0] - 1), range(1, a.shape[1] - 1)):
            g[r, c] = min(f[r, c], max(a[r, c], f[r - 1 : r + 2, c - 1 : c + 2].min()))
        if (g == f).all():
            return f
        f = g


def test_depressions_and_flow(spark, tmp_path):
    a = np.random.default_rng(5).uniform(0, 5, (14, 11))
    p = _pixels(spark, {3: a})
    got = hydrology.depressions(p, 0.5)
    want = _levels(a)
    assert np.allclose(_back(got, "filled", {3: a.shape})[3], want)
    assert np.allclose(_back(got, "depth", {3: a.shape})[3], np.where(want - a >= 0.5, want - a, 0))
    acc = _back(hydrology.accumulation(p), "acc", {3: a.shape})[3]
    sinks_ = _back(detect.flow_direction(p), "direction", {3: a.shape})[3] == -1
    assert acc[sinks_].sum() == a.size and acc.min() == 1  # each cell ends in one sink


def test_regions(spark):
    a = np.random.default_rng(6).integers(0, 3, (9, 13)).astype(float)
    got = hydrology.regions(_pixels(spark, {1: a})).collect()
    seen, label = {}, {}
    for start in np.ndindex(a.shape):
        if start in label:
            continue
        todo, label[start] = [start], start
        while todo:
            r, c = todo.pop()
            for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= q[0] < 9 and 0 <= q[1] < 13 and q not in label and a[q] == a[r, c]:
                    label[q] = start
                    todo.append(q)
    for v in label.values():
        seen[v] = seen.get(v, 0) + 1
    assert {(r["row"], r["col"]): (r["region"], r["area"]) for r in got} == {p: (v[0] * (1 << 26) + v[1], seen[v]) for p, v in label.items()}
    assert hydrology.regions(_pixels(spark, {1: a}), least_area=5).filter("area < 5").count() == 0


def test_inversion_against_least_squares(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for p in range(40):
        days = np.sort(rng.choice(2000, rng.integers(3, 9), replace=False))
        pairs = [(i, j) for i in range(len(days)) for j in range(i + 1, min(len(days), i + 4))]
        phase, coh = rng.standard_normal(len(pairs)), rng.uniform(0.3, 1, len(pairs))
        a = np.zeros((len(pairs), len(days)))
        for k, (i, j) in enumerate(pairs):
            a[k, i], a[k, j] = -1, 1
            rows.append((p, int(days[i]), int(days[j]), float(phase[k]), float(coh[k])))
        d = phase * inversion.WAVELENGTH_M / (4 * np.pi)
        x = np.linalg.lstsq(a[:, 1:] * coh[:, None], d * coh, rcond=None)[0]
        t = (days - days[0]) / 365.25
        want[p] = (np.polyfit(t, [0, *x], 1)[0], np.sqrt(np.mean((d - a[:, 1:] @ x) ** 2)), len(pairs), len(days))
    ifg = spark.createDataFrame(rows, "pixel long, d1 long, d2 long, phase double, coherence double").repartition(4)
    got = {r["pixel"]: (r["velocity"], r["rms"], r["n"], r["n_dates"]) for r in inversion.invert(ifg).collect()}
    assert set(got) == set(want) and all(np.allclose(got[p], want[p]) for p in want)
    # a bad pair weighs less as a bridge
    bad = ifg.withColumn("bridge", F.col("d1") % 7 == 0)
    light = {r["pixel"]: r["velocity"] for r in inversion.invert(bad, bridge_penalty=1.0).collect()}
    assert all(np.isclose(light[p], want[p][0]) for p in want)
    # a network in two parts has the smallest solution, not an error
    apart = spark.createDataFrame([(1, 0, 10, 1.0, 0.9), (1, 20, 30, 1.0, 0.9), (1, 20, 40, 1.0, 0.9), (1, 30, 40, 0.0, 0.9)], "pixel long, d1 long, d2 long, phase double, coherence double")
    assert inversion.invert(apart).count() == 1


def test_whole_cycles_of_closures(spark):
    ifg = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 2.0 + 2 * np.pi), (1, 0, 2, 3.0)], "pixel long, d1 long, d2 long, phase double")
    row = inversion.closures(ifg).first()
    assert row["cycles"] == 1 and np.isclose(row["closure"], 2 * np.pi)


# networks


def _days(spark, tracks: dict[str, list[int]]):
    return spark.createDataFrame([(k, datetime(2017, 10, 25) + timedelta(days=d)) for k, v in tracks.items() for d in v], "track string, date timestamp").withColumn("date", F.to_date("date"))


def test_thinning_keeps_the_network(spark):
    long = [6 * i + (12 if i > 100 else 0) for i in range(225)]
    kept = network.thinned_days(long, 72, thin_to=24)
    assert kept[0] == long[0] and kept[-1] == long[-1] and kept == sorted(set(kept) & set(long))
    assert network._parts(kept, 72) == 1 and len(kept) < len(long) / 3
    assert len(network.thinned_days(long, 72, most=40)) <= 40
    gap = [*range(0, 100, 6), *range(400, 500, 6)]
    assert network._parts(network.thinned_days(gap, 24, thin_to=12), 24) == 2
    assert network.thinned_days([1, 2], 5, 3) == [1, 2] and network.thinned_days(long, 72) == long
    got = network.thin(_days(spark, {"a": long, "b": [0, 1]}), "track", 72, thin_to=24)
    assert got.filter("kept AND track = 'a'").count() == len(kept) and got.filter("kept AND track = 'b'").count() == 2


def test_cadence():
    assert network.cadence([], 5) == [] and network.cadence([1, 2, 3], 1) == [1, 2, 3]
    assert network.cadence([0, 6, 12, 18, 24, 30], 12) == [0, 12, 24, 30]
    assert network.cadence([0, 5, 6, 7, 20], 6) == [0, 6, 20]


def test_selected_network_is_connected_and_redundant(spark):
    rng = random.Random(1)
    rows = [("t", i, j, rng.uniform(1, 100), rng.random()) for i in range(12) for j in range(i + 1, min(12, i + 4))] + [("u", 0, 1, 5.0, 0.1), ("u", 1, 2, 5.0, 0.9), ("u", 0, 2, 9.0, 0.05)]
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c))
    p = spark.createDataFrame(rows, "track string, a int, b int, base double, coh double").withColumns({"d1": day("a"), "d2": day("b")})
    out = network.select_network(p, "track", F.col("base") / F.greatest("coh", F.lit(0.05)), F.col("coh") >= 0.3).toPandas()
    assert set(out["kind"]) <= {"good", "bridge", "excluded"} and len(out) == len(rows)
    for _, g in out.groupby("track"):
        sets = network._Sets({*g["a"], *g["b"]})
        for r in g[g["kind"] != "excluded"].itertuples():
            sets.join(r.a, r.b)
        assert len({sets.find(x) for x in sets.up}) == 1
    assert (out[out["kind"] == "good"]["coh"] >= 0.3).all() and (out[out["kind"] == "bridge"]["coh"] < 0.3).all()
    u = out[out["track"] == "u"].set_index(["a", "b"])["kind"].to_dict()
    assert u == {(1, 2): "good", (0, 1): "bridge", (0, 2): "excluded"}
    kinds = network.classify_pairs(p.filter("track = 'u' OR (track = 't' AND b = a + 1)"), "track", F.col("coh") >= 0.3).toPandas()
    assert (kinds[(kinds["track"] == "t") & (kinds["coh"] < 0.3)]["kind"] == "bridge").all() and set(kinds[(kinds["track"] == "u") & (kinds["coh"] < 0.3)]["kind"]) == {"excluded"}


def test_incremental_pairs(spark):
    old, new = _days(spark, {"a": [0, 6, 12, 18]}), _days(spark, {"a": [24, 18]})
    got = sorted(((r["d1"] - date(2017, 10, 25)).days, (r["d2"] - date(2017, 10, 25)).days) for r in network.incremental_pairs(old, new, "track", 2).collect())
    assert got == [(12, 24), (18, 24)]
    assert network.incremental_pairs(old, new.limit(0), "track").count() == 0


# scenes


def _scenes(spark):
    rows = [(f"s{i}", "p", 5, datetime(2024, 1, 1) + timedelta(days=i), float(10 * i), "L2A", "Sentinel-2A", "MSI", None, None, None, "c", 10.0, -75.0, 40.0, -73.0, 42.0, "{}") for i in range(5)]
    return spark.createDataFrame(rows, "id string, provider string, track int, datetime timestamp, cloud_cover double, processing_level string, satellite string, sensor string, product_type string, polarisation string, pass_direction string, collection string, resolution_m double, min_lon double, min_lat double, max_lon double, max_lat double, properties string").withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def test_queries_are_checked_and_searches_distinct(spark):
    for bad in ({"cloud_min": 50.0, "cloud_max": 10.0}, {"start": "2024-02-01", "end": "2024-01-01"}, {"bbox": (1, 0, 0, 1)}, {"resolution_min": 9.0, "resolution_max": 1.0}):
        with pytest.raises(ValueError):
            catalog.SceneQuery(**bad)
    s = _scenes(spark)
    assert catalog.search(s.unionByName(s), catalog.SceneQuery(), "2024-02-01").count() == 5
    q = catalog.SceneQuery(cloud_max=20.0, overrides={"x": {"cloud_max": 90.0}})
    assert q.for_provider("x").cloud_max == 90.0 and q.for_provider("y").cloud_max == 20.0
    radar = catalog.SceneQuery(product_type="SLC")
    with pytest.raises(ValueError):
        catalog.federated({"x": s}, radar, "2024-02-01", {"x": {"optical"}})


def test_preflight_codes(spark):
    rules = preflight.Rules(area=(-74.1, 40.6, -73.7, 40.9), cloud_max=25.0, level="L2A", bands=("B04",))
    with_bands = _scenes(spark).withColumn("bands", F.array(F.lit("red")))
    got = {r["id"]: [i["code"] for i in r["issues"]] for r in preflight.validated(with_bands, rules).collect()}
    assert got["s0"] == [] and got["s4"] == ["CLOUD_COVER_EXCEEDED"]
    assert preflight.passing(with_bands, rules).columns == with_bands.columns and preflight.passing(with_bands, rules).count() == 3
    missing = preflight.validated(_scenes(spark).withColumn("min_lon", F.lit(None).cast("double")), rules).first()
    assert [i["code"] for i in missing["issues"]][:2] == ["NO_FOOTPRINT", "MISSING_BANDS"] and not missing["passed"]


def test_sinks_round_trip(spark, tmp_path):
    s = _scenes(spark)
    for kind in ("geojson", "stac", "csv", "parquet"):
        sinks.write(s, f"{tmp_path}/{kind}", kind)
    items = stac.read_items(spark, f"{tmp_path}/stac", "p")
    assert items.count() == 5 and {r["cloud_cover"] for r in items.collect()} == {0.0, 10.0, 20.0, 30.0, 40.0} and items.first()["min_lon"] == -75.0
    feature = json.loads(spark.read.text(f"{tmp_path}/geojson").first()[0])
    assert feature["geometry"]["coordinates"][0][0] == [-75.0, 40.0]
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 5 and spark.read.parquet(f"{tmp_path}/parquet").filter("provider = 'p'").count() == 5
    assert sinks.manifest(s, ["id"]).first() == sinks.manifest(s.orderBy(F.desc("id")), ["id"]).first()
    with pytest.raises(ValueError):
        sinks.write(s, f"{tmp_path}/x", "other")


# streams and state


def test_monitoring_is_idempotent(spark, tmp_path):
    at = f"file://{tmp_path}"
    day = lambda n: _days(spark, {"a": list(range(n))})
    run = lambda: monitor.run_available(spark, f"{at}/in", day(1).schema, f"{at}/state", f"{at}/ck", ["track", "date"])
    day(3).write.parquet(f"{at}/in")
    run(), run()
    assert monitor.processed(spark, f"{at}/state").count() == 3
    day(5).write.mode("append").parquet(f"{at}/in")
    run(), run()
    got = monitor.processed(spark, f"{at}/state")
    assert got.count() == 5 == got.distinct().count()
    for i in range(3):
        monitor.record_run(spark, f"{at}/log", i, "ok", i)
    assert [r["run_id"] for r in monitor.run_history(spark, f"{at}/log", 2).collect()] == [2, 1]


def test_arrivals_of_a_stream(spark, tmp_path):
    _scenes(spark).write.parquet(f"{tmp_path}/s")
    stream = monitor.arrivals(spark.readStream.schema(_scenes(spark).schema).parquet(f"{tmp_path}/s"))
    q = stream.writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrived").agg(F.sum("n")).first()[0] == 5


# measures and vectors


def test_kmeans_assigns_to_the_nearest_centre(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(c, 0.2, (80, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(v)] + [(999, None, 1.0)]
    got = detect.kmeans(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"], 3).toPandas()
    assert got[got["id"] == 999]["cluster"].tolist() == [-1]
    g = got[got["cluster"] >= 0].sort_values("id")
    centres = g.groupby("cluster")[["a", "b"]].mean().to_numpy()
    d = ((g[["a", "b"]].to_numpy()[:, None] - centres) ** 2).sum(-1)
    assert (np.sort(g["cluster"].unique())[d.argmin(1)] == g["cluster"]).all() and d.min(1).mean() < 0.2


def test_principal_components_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "id int, a double, b double, c double")
    got = series.principal_components(df, ["a", "b", "c"], 2).orderBy("id").toPandas()
    assert got[got["id"] == 999][["pc1", "pc2"]].isna().all().all()
    _, vec = np.linalg.eigh(np.cov(x.T))
    for n in (0, 1):
        v = vec[:, -1 - n] * np.sign(vec[np.abs(vec[:, -1 - n]).argmax(), -1 - n])
        assert np.allclose(got[got["id"] < 999][f"pc{n + 1}"], (x - x.mean(0)) @ v)
    assert series.principal_components(df.limit(0), ["a", "b"], 1).count() == 0


def test_percentiles_of_hot_and_odd_zones(spark):
    rng = np.random.default_rng(9)
    zones = {1: rng.standard_normal(5000), 2: np.full(300, 2.5), 3: np.array([7.0]), 4: np.repeat(rng.integers(0, 4, 50), 20).astype(float)}
    df = spark.createDataFrame([(z, float(v)) for z, a in zones.items() for v in a] + [(5, None)], "zone int, v double")
    got = {(r["zone"], r["share"]): r["value"] for r in series.zone_percentiles(df, "zone", (0.0, 0.1, 0.5, 0.99, 1.0), bins=64).collect()}
    assert set(got) == {(z, s) for z in zones for s in (0.0, 0.1, 0.5, 0.99, 1.0)}
    assert all(np.isclose(got[z, s], np.quantile(a, s)) for z, a in zones.items() for s in (0.0, 0.1, 0.5, 0.99, 1.0))


def test_clipping_and_simplifying():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    area = lambda a: abs((a[:, 0] * np.roll(a[:, 1], -1) - np.roll(a[:, 0], -1) * a[:, 1]).sum()) / 2 if len(a) else 0.0
    assert area(vectors.clip(square, square + 2)) == 4 and area(vectors.clip(square, (square + 2)[::-1])) == 4
    assert area(vectors.clip(square, square + 9)) == 0
    triangle = np.array([(0, 0), (8, 0), (0, 8)], float)
    assert area(vectors.clip(square, triangle)) == 16 and np.isclose(area(vectors.clip(square * 2, triangle)), 32)
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], float)
    assert vectors.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]


def test_join_of_boxes_gives_each_pair_once(spark):
    rng = random.Random(3)
    box = lambda i: (lambda x, y: (i, x, y, x + rng.uniform(0, 30), y + rng.uniform(0, 30)))(rng.uniform(-50, 50), rng.uniform(-50, 50))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    got = vectors.join_boxes(spark.createDataFrame(a, "i int, ax0 double, ay0 double, ax1 double, ay1 double"), spark.createDataFrame(b, "j int, bx0 double, by0 double, bx1 double, by1 double"), 7.0).select("i", "j").collect()
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want


def test_spectral_filter_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(11)
    y, x = np.mgrid[0:20, 0:26]
    a = np.angle(np.exp(1j * (0.3 * x + 0.1 * y + 0.8 * rng.standard_normal(x.shape))))
    p = _pixels(spark, {1: a})
    one, many = (_back(phase.goldstein(p, window=8).select("scene_id", "row", "col", "out"), "out", {1: a.shape})[1] for _ in (0, 1))
    small = _back(stencil.stencil(p, 2, lambda x: {"out": stencil.box_mean(x["v"], 5)}, ["out"], tile=7), "out", {1: a.shape})[1]
    assert np.allclose(one, many, equal_nan=True) and np.isfinite(one).mean() > 0.9 and np.isfinite(small).all()
    clean = 0.3 * x + 0.1 * y
    off = lambda v: np.nanmean(1 - np.cos(v - clean))
    assert off(one) < off(a)


def test_offsets_between_cells(spark):
    rng = np.random.default_rng(12)
    a = rng.standard_normal((40, 44))
    b = np.roll(a, (2, -3), (0, 1))
    rows = [(1, int(r), int(c), float(a[r, c]), float(b[r, c])) for r, c in np.ndindex(a.shape)]
    got = phase.offsets(spark.createDataFrame(rows, "scene_id long, row int, col int, a double, b double"), chip=8, reach=5, step=6).collect()
    assert got and all(abs(r["d_row"] - 2) < 0.3 and abs(r["d_col"] + 3) < 0.3 and r["reliable"] for r in got)
    flat = phase.correlate(np.ones((3, 3)), rng.standard_normal((6, 6)))
    assert (flat == 0).all()


def test_orbit_states_and_files(spark, tmp_path):
    t = np.arange(12) * 10.0
    x = np.sin(t / 40) * 7e6
    at = [-5.0, 0.0, 3.0, 44.9, 45.1, 109.0, 115.0]
    got = orbits.interpolated(spark.createDataFrame([("o", float(a), float(b)) for a, b in zip(t, x)], "k string, t double, x double"), spark.createDataFrame([(i, "o", v) for i, v in enumerate(at)] + [(99, "none", 1.0)], "id int, k string, t double"), "k", "t", ["x"], "id")
    got = {r["id"]: r["x"] for r in got.collect()}
    for i, v in enumerate(at):
        c = int(np.clip(np.abs(t - v).argmin(), 2, len(t) - 3))
        p = np.polyfit((t[c - 2 : c + 3] - t[c]) / 10, x[c - 2 : c + 3], 4)
        assert np.isclose(got[i], np.polyval(p, (v - t[c]) / 10), rtol=1e-6)
    assert got[99] is None
    (tmp_path / "a.EOF").write_text("<E><List><OSV><UTC>UTC=2024-01-01T00:00:10.500000</UTC><X>1.5</X><Y>2</Y><Z>3</Z><VX>4</VX><VY>5</VY><VZ>-6</VZ></OSV></List></E>")
    (tmp_path / "b.xml").write_text("<p><swathTiming><linesPerBurst>1501</linesPerBurst><burstList><burst><azimuthTime>2024-01-01T00:00:01</azimuthTime><sensingTime>2024-01-01T00:00:02</sensingTime></burst></burstList></swathTiming><azimuthTimeInterval>0.002</azimuthTimeInterval><slantRangeTime>0.005</slantRangeTime><radarFrequency>5405000454.33435</radarFrequency><calibrationVector><line>0</line><pixel>0 40</pixel><sigmaNought>300.5 301</sigmaNought></calibrationVector></p>")
    files = products.read_files(spark, str(tmp_path))
    row = products.orbit_vectors(files).collect()
    assert len(row) == 1 and row[0]["vz"] == -6.0 and row[0]["time"].microsecond == 500000
    burst = products.bursts(files).collect()
    assert len(burst) == 1 and burst[0]["lines"] == 1501 and burst[0]["interval"] == 0.002
    assert np.isclose(products.radar_geometry(files).first()["wavelength_m"], 0.05546576, atol=1e-6)
    assert [tuple(r)[1:] for r in products.calibration_table(files).collect()] == [(0, 0, 300.5), (0, 40, 301.0)]
