"""Operators on small tables: invariants, brute force, and recovery of known parameters."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.functions.labels import depth_group, interval_label, midpoint, number_label, range_of
from quakespark.functions.students_t import quantile, two_sided_p
from quakespark.operators import catalog, exposure, logo, omori, resample, segments, stats
from quakespark.sources import geojson, sinks


def subgroups(spark):
    labels = [("depth", "0-10km"), ("depth", "10-20km"), ("region", "East_of_ms"), ("region", "West_of_ms"), ("ring", "0-50km"), ("ring", "50-400km"), ("depth", "all_depth"), ("depth", "all_relaxed"), ("ring", "0-400km")]
    rows = [(f"m{g + 1}|{k}|{s}", f"m{g + 1}", k, s, 6.0 + 0.3 * g, 25 + r, 10 ** (5.0 + 0.1 * r + 0.05 * g), 0.45 + 0.04 * g - 0.015 * r) for g in range(3) for r, (k, s) in enumerate(labels)]
    return spark.createDataFrame(rows, "record_id string, mainshock_id string, subgroup_type string, subgroup string, mainshock_mag double, n_events int, pop_sum_subgroup double, p double")


def test_sample_and_design(spark):
    out = stats.analysis_sample(subgroups(spark))
    assert out.count() == 18 and out.where("subgroup in ('all_depth', 'all_relaxed', '0-400km')").count() == 0
    fit = stats.within_fe(out).collect()
    assert "mainshock_mag" not in {r.term for r in fit} and len({r.n_parameters for r in fit}) == 1
    with pytest.raises(ValueError):
        stats.analysis_sample(out.drop("p"))


def test_permutation_keeps_each_group(spark):
    sample = stats.analysis_sample(subgroups(spark))
    own = {r.mainshock_id: sorted(r.v) for r in sample.groupBy("mainshock_id").agg(F.collect_list("pop_sum_subgroup").alias("v")).collect()}
    got = resample.permute_within(sample, "pop_sum_subgroup", "mainshock_id", "record_id", 6, 7).groupBy("rep", "mainshock_id").agg(F.collect_list("pop_sum_subgroup").alias("v"), F.count("*").alias("n")).collect()
    assert len(got) == 18 and all(sorted(r.v) == own[r.mainshock_id] for r in got)


def test_models_and_folds_are_all_reported(spark):
    sample = stats.analysis_sample(subgroups(spark))
    models, predictions = logo.compare(sample)
    assert models.count() == 9 and predictions.count() == 54
    assert {r.model for r in logo.metrics(predictions).collect()} == {"mean", "ols", "ridge"}
    assert logo.splits(sample, "mainshock_id").groupBy("test_group").agg(F.sum(F.col("is_test").cast("int")).alias("n")).where("n <> 6").count() == 0
    assert stats.errors(spark.createDataFrame([(0.5, 0.4), (0.5, 0.6)], "t double, p double"), "t", "p", []).first().r2 is None


def test_exact_permutation_of_identity(spark):
    rows = spark.createDataFrame([("a", float(i), float(i)) for i in range(6)], "g string, x double, y double")
    found = resample.exact_permutation(rows, "x", "y", ["g"]).first()
    assert found.n_orders == 720 and found.observed == pytest.approx(1.0) and found.p_value == pytest.approx(2 / 720)
    orders = resample.orders_of(np.arange(24), 4)
    assert len({tuple(o) for o in orders.tolist()}) == 24 and all(sorted(o) == [0, 1, 2, 3] for o in orders.tolist())
    with pytest.raises(ValueError):
        resample.exact_permutation(spark.range(11).selectExpr("'a' g", "id x", "id y"), "x", "y", ["g"])


def test_draw_matrix(spark):
    records = spark.createDataFrame([("a",), ("b",)], "record_id string")
    draws = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.3), ("b", 0, 0.7), ("b", 1, 0.9)], "record_id string, draw int, p_boot double")
    got = resample.draw_matrix(records, draws, 20, 7).collect()
    assert len(got) == 40 and {r.p for r in got if r.record_id == "a"} == {0.1, 0.3} and {r.p for r in got if r.record_id == "b"} == {0.7, 0.9}
    with pytest.raises(ValueError):
        resample.draw_matrix(spark.createDataFrame([("c",)], "record_id string"), draws, 2, 7)


def test_student_t():
    assert two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and two_sided_p(0, 3) == 1
    assert quantile(0.975, 24) == pytest.approx(2.063898562, abs=1e-8) and two_sided_p(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)


def simulated(r, n, c, p, low, high):
    a, b = (low + c) ** (1 - p), (high + c) ** (1 - p)
    return np.array([(a + r.random() * (b - a)) ** (1 / (1 - p)) - c for _ in range(n)])


def test_fit_recovers_and_is_best(spark):
    r = random.Random(2)
    rows = []
    for name, n, c, p in (("a", 4000, 0.05, 1.1), ("b", 400, 0.3, 0.8), ("c", 30, 0.01, 1.3), ("few", 10, 0.1, 1.1)):
        rows += [(name, float(t)) for t in simulated(r, n, c, p, 0.01, 100.0)]
    times = spark.createDataFrame(rows, "record_id string, t_days double")
    fits = {x.record_id: x for x in omori.fit(times, ["record_id"], 0.01, 100.0).collect()}
    assert set(fits) == {"a", "b", "c"} and abs(fits["a"].p - 1.1) < 0.06 and fits["a"].n_events == 4000
    grid = {x.record_id: x for x in omori.grid_fit(times, ["record_id"], 0.01, 100.0).collect()}
    for name, own in fits.items():
        t = np.array([x for k, x in rows if k == name])
        c, p = np.meshgrid(np.exp(np.linspace(math.log(1e-6), math.log(10), 60)), np.linspace(0.2, 5, 80))
        logs = np.log(t[:, None] + np.exp(np.linspace(math.log(1e-6), math.log(10), 60))[None, :]).sum(axis=0)
        best = omori.profile(c, p, len(t), logs[None, :], 0.01, 100.0).min()
        assert own.nll <= best + 1e-6 and own.nll <= grid[name].nll + 1e-6
        nll = omori.negative_log_likelihood(times.where(F.col("record_id") == name), ["record_id"], own.k, own.c, own.p, 0.01, 100.0).first().nll
        assert nll == pytest.approx(own.nll, abs=1e-6)
    draws = omori.bootstrap(times, spark.createDataFrame([(k, v.c) for k, v in fits.items()], "record_id string, c double"), 0.01, 100.0, 60, 7)
    got = {x.record_id: x for x in omori.intervals(draws, "p_boot", ["record_id"]).collect()}
    assert got["a"].n_draws == 60 and got["a"].p_lo < fits["a"].p < got["a"].p_hi


def test_fit_is_the_same_however_times_are_dealt(spark):
    r = random.Random(5)
    times = spark.createDataFrame([("a", float(t)) for t in simulated(r, 3000, 0.05, 1.1, 0.01, 100.0)], "record_id string, t_days double")
    one, many = (omori.fit(times.repartition(n), ["record_id"], 0.01, 100.0).first() for n in (1, 7))
    assert one.p == pytest.approx(many.p, abs=1e-9) and one.nll == pytest.approx(many.nll, abs=1e-6) and one.n_events == many.n_events == 3000


def test_bootstrap_draws_are_fits_of_resampled_times(spark):
    r = random.Random(8)
    t = simulated(r, 300, 0.05, 1.1, 0.01, 100.0)
    times = spark.createDataFrame([("a", f"e{i}", float(x)) for i, x in enumerate(t)], "record_id string, usgs_id string, t_days double")
    fits = omori.fit(times, ["record_id"], 0.01, 100.0)
    draws = {x.draw: x.p_boot for x in omori.bootstrap(times, fits, 0.01, 100.0, 8, 7).collect()}
    again = {x.draw: x.p_boot for x in omori.bootstrap(times.repartition(5), fits, 0.01, 100.0, 8, 7).collect()}
    assert draws.keys() == again.keys() == set(range(8)) and all(abs(draws[k] - again[k]) < 1e-5 for k in draws)
    keys = [x.k for x in times.select(F.xxhash64("usgs_id", "t_days").alias("k"), "t_days").collect()]
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    weights = np.searchsorted(cdf, omori._uniform(np.array(keys).view(np.uint64), np.arange(8), 7), "right")
    c = np.exp(np.linspace(math.log(1e-6), math.log(10), 2000))
    for k in range(8):
        logs = (weights[:, k, None] * np.log(t[:, None] + c[None, :])).sum(axis=0)
        nll, p = omori.best_p(c, np.full(len(c), float(weights[:, k].sum())), logs, 0.01, 100.0)
        assert draws[k] == pytest.approx(p[np.argmin(nll)], abs=0.02)


def test_gates_on_all_times_and_on_the_window(spark):
    inside = [("enough", 0.02 + 0.1 * i) for i in range(21)] + [("enough", 0.001)] * 4
    few_raw = [("raw", 0.02 + 0.1 * i) for i in range(24)]
    few_window = [("window", 0.02 + 0.1 * i) for i in range(19)] + [("window", 200.0)] * 20
    times = spark.createDataFrame(inside + few_raw + few_window, "record_id string, t_days double")
    for how in (omori.fit, omori.grid_fit):
        assert {(x.record_id, x.n_events) for x in how(times, ["record_id"], 0.01, 100.0, raw=25).collect()} == {("enough", 21)}


def test_sensitivity_is_a_fit_of_each_cell(spark):
    r = random.Random(6)
    events = spark.createDataFrame([(float(t), 1 + 2 * r.random()) for t in simulated(r, 900, 0.1, 1.05, 0.005, 100.0)], "t_days double, mag double")
    got = {(x.mc, x.tmin_days): x for x in omori.sensitivity(events, [1.0, 1.5, 2.9], [0.01, 0.1], 100.0, 200).collect()}
    assert set(got) == {(m, s) for m in (1.0, 1.5) for s in (0.01, 0.1)}
    for (mc, start), own in got.items():
        alone = omori.fit(events.where(F.col("mag") >= mc).withColumn("all", F.lit("x")), ["all"], start, 100.0).first()
        assert own.n_events == alone.n_events and own.p == pytest.approx(alone.p, abs=1e-5)


def test_relaxed_rows(spark):
    fits = spark.createDataFrame([("m|depth|all_depth", "m", "depth", "all_depth"), ("n|depth|all_depth", "n", "depth", "all_depth"), *[(f"n|ring|{i}", "n", "ring", str(i)) for i in range(6)]], "record_id string, mainshock_id string, subgroup_type string, subgroup string")
    whole = spark.createDataFrame([("m", 0.9), ("n", 1.0), ("none", 1.1)], "mainshock_id string, p double")
    got = {r.record_id: r.p for r in omori.relaxed(whole, fits).collect()}
    assert got == {"m|depth|all_relaxed": 0.9, "none|depth|all_relaxed": 1.1}


def plain_depths(d, least):
    """The depth rule on plain values, by trying all cuts."""
    d = sorted(d)
    n = len(d)
    if n < 2 * least:
        return []
    cnt = lambda lo, hi, first: sum((lo <= x if first else lo < x) and x <= hi for x in d)
    for k in (3, 2):
        cuts = sorted({c for c in (float(np.quantile(d, i / k)) for i in range(1, k)) if c > d[0] + 1e-9})
        if len(cuts) < k - 1:
            u = sorted(set(d))
            pairs = [[x] for x in u[1:-1]] if k == 2 else [[u[i], u[j]] for i in range(1, len(u) - 2) for j in range(i + 1, len(u) - 1)]
            good = [p for p in pairs if p[0] > d[0] + 1e-9 and min(cnt(a, b, q == 0) for q, (a, b) in enumerate(zip([d[0], *p], [*p, math.inf], strict=True))) >= least]
            if not good:
                continue
            cuts = good[0]
        edges = [d[0], *cuts, math.inf]
        segs = segments.merge_sparse(list(zip(edges, edges[1:], strict=False)), lambda s: [cnt(a, b, q == 0) for q, (a, b) in enumerate(s)], least)
        counts = [cnt(a, b, q == 0) for q, (a, b) in enumerate(segs)]
        if len(segs) >= 2 and min(counts) >= least:
            return segs
    return []


def test_depth_segments_against_plain_rule():
    r = random.Random(7)
    for _ in range(600):
        d = [float(r.choice([10, 10, 10, 5, 12, r.randint(0, 30)])) for _ in range(r.randint(0, 60))]
        values = sorted(set(d))
        own = segments.depth_segments_of(segments.Depths(values, [d.count(v) for v in values]), 5)
        want = plain_depths(d, 5)
        assert len(own) == len(want) and all(a == pytest.approx(b) for a, b in zip(own, want, strict=True)), (sorted(d), own, want)


def plain_bins(d, bins, least, most=3):
    """Fixed bins merged pair by pair on the values themselves, thirds or halves where one is left."""
    cnt = lambda s: sum(s[0] <= x < s[1] for x in d)
    segs = list(zip(bins, [*bins[1:], math.inf], strict=True))

    def merged(segs):
        n = [cnt(s) for s in segs]
        i = n.index(min(n))
        j = 1 if i == 0 else i - 1 if i == len(segs) - 1 or n[i - 1] <= n[i + 1] else i + 1
        a, b = min(i, j), max(i, j)
        return segs[:a] + [(segs[a][0], segs[b][1])] + segs[b + 1 :]

    while len(segs) > 1 and min(map(cnt, segs)) < least:
        segs = merged(segs)
    while len(segs) > most:
        segs = merged(segs)
    segs = [s for s in segs if cnt(s)] if d else []
    if len(segs) > 1 or not d:
        return segs
    for k in (3, 2):
        cuts = [min(d), *np.quantile(d, [i / k for i in range(1, k)]).tolist(), math.inf]
        out = list(zip(cuts, cuts[1:], strict=False))
        if len(d) >= k * least and min(map(cnt, out)) >= least:
            return out
    return [s for s in segs if not (math.isinf(s[1]) and s[0] <= bins[0] + 1e-9)]


def test_binned_depth_segments_against_plain_rule():
    r = random.Random(17)
    bins = [0, 10, 20, 40, 80, 300]
    for _ in range(600):
        d = [float(r.choice([1, 15, 30, 60, 100, r.randint(-5, 400), r.uniform(0, 12)])) for _ in range(r.randint(0, 80))]
        if not any(0 <= x for x in d):
            continue
        values = sorted(set(d))
        own = segments.binned_depth_segments(segments.Depths(values, [d.count(v) for v in values]), bins, 8)
        want = plain_bins(d, bins, 8)
        assert len(own) == len(want) and all(a == pytest.approx(b) for a, b in zip(own, want, strict=True)), (sorted(d), own, want)
    five = segments.Depths([1, 15, 30, 60, 100], [40] * 5)
    assert len(segments.binned_depth_segments(five, bins, 25)) == 3


def test_merge_sparse():
    count = lambda table: lambda segs: [sum(v for k, v in table.items() if lo <= k < hi) for lo, hi in segs]
    rings = [(0, 50), (50, 150), (150, 400)]
    assert segments.merge_sparse(rings, count({0: 30, 60: 30, 200: 30}), 25) == rings
    assert segments.merge_sparse(rings, count({0: 30, 60: 5, 200: 40}), 25) == [(0, 150), (150, 400)]
    assert segments.merge_sparse(rings, count({0: 5, 60: 5, 200: 5}), 25) == [(0, 400)]
    assert segments.merge_sparse(rings, count({0: 40, 60: 5, 200: 30}), 25) == [(0, 50), (50, 400)]


def test_decluster_and_pairs_against_plain(spark):
    r = random.Random(9)
    rows = [(f"e{i}", r.randint(0, 40 * catalog.DAY_US), r.uniform(-89, 89), r.uniform(-180, 180), float(i % 3)) for i in range(300)]
    events = spark.createDataFrame(rows, "usgs_id string, time_us long, lat double, lon double, mag double")
    kept, last = [], None
    for e in sorted(rows, key=lambda e: (e[1], e[0])):
        if last is None or e[1] - last >= 2 * catalog.DAY_US:
            kept.append(e[0])
            last = e[1]
    assert sorted(x.usgs_id for x in catalog.decluster(events, 2).collect()) == sorted(kept)
    assert sorted(x.usgs_id for x in catalog.decluster(events, 2, 5).collect()) == sorted(kept[:5])
    centers = spark.createDataFrame([("a", 10.0, 179.9), ("b", 88.5, 0.0), ("c", -45.0, -60.0)], "c string, c_lat double, c_lon double")

    def far(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    got = {(x.c, x.usgs_id) for x in catalog.near_pairs(events, centers, 2500.0).collect()}
    want = {(c.c, e[0]) for c in centers.collect() for e in rows if far(e[2], e[3], c.c_lat, c.c_lon) <= 2500}
    assert got == want and len(want) > 20


def test_edges_of_rings_and_circles(spark):
    centers = spark.createDataFrame([("m", 0.0, 0.0), ("none", 60.0, 100.0)], "mainshock_id string, c_lat double, c_lon double")
    degree = math.pi / 180 * 6371.0088
    pixels = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 10.0), (2.0, 0.0, 100.0), (0.5, 0.0, None)], "lat double, lon double, pop double")
    got = {r.mainshock_id: r for r in exposure.buffers(pixels, centers, [50, math.ceil(2 * degree)]).collect()}
    assert got["m"].pop_sum_50km == 1.0 and got["none"].pop_sum_50km is None and got["m"][f"pop_sum_{math.ceil(2 * degree)}km"] == 111.0
    rings = spark.createDataFrame([("m", "ring", "0-50km"), ("m", "ring", "50-300km"), ("m", "region", "North_of_ms"), ("m", "depth", ">=3km"), ("x", "ring", "0-50km"), ("m", "ring", "bad")], "mainshock_id string, subgroup_type string, subgroup string")
    own = {r.subgroup: r.pop_sum_subgroup for r in exposure.subgroup_exposure(pixels, centers, rings, 300.0).collect()}
    assert own == {"0-50km": None, "50-300km": 110.0, "North_of_ms": 111.0, ">=3km": 111.0, "bad": None}


def test_labels(spark):
    frame = spark.createDataFrame([(17.4, 50.0), (0.0, 10.0), (70.6666666667, float("inf")), (123456.0, 1e6)], "lo double, hi double")
    got = [r[0] for r in frame.select(interval_label(F.col("lo"), F.col("hi"))).collect()]
    assert got == ["17.4-50km", "0-10km", ">=70.6667km", "123456-1000000km"]
    rows = spark.createDataFrame([("0-50km",), (">=17.4km",), ("West_of_ms",), ("10.5 - 20 KM",)], "s string")
    low, high = range_of(F.lower("s"))
    assert [(r[0], r[1], r[2]) for r in rows.select(low, high, midpoint(F.col("s"))).collect()] == [(0.0, 50.0, 25.0), (None, None, 17.4), (None, None, 0.0), (10.5, 20.0, 0.0)]
    groups = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (300.0,), (None,)], "d double")
    assert [r[0] for r in groups.select(depth_group(F.col("d"), [0, 10, 300])).collect()] == [">=300km", "0-10km", "0-10km", "10-300km", ">=300km", "unknown"]
    assert spark.range(1).select(number_label(F.lit(0.5))).first()[0] == "0.5"


def test_geojson_cases(spark, tmp_path):
    feature = lambda i, **x: {"type": "Feature", "id": i, "properties": {"time": x.get("time", 1000), "mag": x.get("mag", 2.0), "place": None}, "geometry": x.get("geometry", {"type": "Point", "coordinates": x.get("at", [1.0, 2.0, 3.0])})}
    pages = {"ms1/events.json": [feature("ms1", time=500), feature("a"), feature("b", mag=None), feature("c", geometry=None), feature("d", at=[1.0, 2.0]), feature("e", at=[1.0, 2.0, None]), feature("at", time=500), feature("early", time=400)], "ms1/page2.json": [feature("a"), feature("f", time=2000)], "ms2/events.json": []}
    for name, features in pages.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "metadata": {"count": len(features)}, "features": features}, indent=1))
    rows = geojson.to_catalog(geojson.read_collections(spark, str(tmp_path)))
    assert sorted(r.usgs_id for r in rows.collect()) == ["a", "at", "d", "e", "early", "f", "ms1"]
    shocks = spark.createDataFrame([("ms1", 500_000, 6.0, 2.0, 1.0)], "usgs_id string, time_us long, mag double, lat double, lon double")
    kept = catalog.clean_run(rows, shocks, True)
    assert sorted(r.usgs_id for r in kept.collect()) == ["a", "d", "e", "f"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m", "e", 1.0, float("nan")), ("n", "f", float("inf"), 2.0)], "mainshock_id string, usgs_id string, t_days double, mag double").withColumn("time_utc", F.lit("2020-01-01").cast("timestamp"))
    sinks.write_catalog(rows, f"{tmp_path}/c/catalog.parquet")
    assert sinks.load_catalog(spark, f"{tmp_path}/c").count() == 2
    rows.select("mainshock_id", "usgs_id").write.option("header", True).csv(f"{tmp_path}/d/catalog.csv")
    assert sinks.load_catalog(spark, f"{tmp_path}/d", "mainshock_id string, usgs_id string").count() == 2
    sinks.write_json(rows, f"{tmp_path}/j")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()]
    assert {(x["t_days"], x["mag"]) for x in lines} == {(1.0, None), (None, 2.0)} and all(x["time_utc"].startswith("2020") for x in lines)
    fits = spark.createDataFrame([("m", "mainshock", 0.1), ("m", "ring", 0.2)], "mainshock_id string, subgroup_type string, p double")
    assert sorted(r.section for r in sinks.nested_fits(fits).collect()) == ["by_mainshock", "by_subgroup"]


def test_correlations_guard_constants(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0), ("b", 3.0, float("nan"))], "g string, x double, y double")
    got = {r.g: r for r in stats.correlations(rows, "x", "y", ["g"]).collect()}
    assert got["a"].pearson_r is None and got["a"].slope is None and got["b"].pearson_r == pytest.approx(-1) and got["b"].n == 2



def test_order_permutation_takes_all_rows(spark):
    rows = spark.range(11).selectExpr("'many' g", "id x", "id y").union(spark.range(5).selectExpr("'few' g", "id x", "id y"))
    found = {r.g: r for r in resample.order_permutation(rows, "x", "y", ["g"], 1000, 7).collect()}
    assert found["few"].n_orders == 120 and abs(found["few"].p_value - 2 / 120) < 1e-12
    assert found["many"].n_orders == 1000 and found["many"].observed == 1 and found["many"].p_value == 1 / 1001
    assert -0.8 < found["many"].null_lo < -0.4 and 0.4 < found["many"].null_hi < 0.8
    drawn = resample.seeded_orders(np.arange(4000), 12, 7)
    assert all(sorted(o) == list(range(12)) for o in drawn.tolist()) and len({tuple(o) for o in drawn.tolist()}) == 4000
    places = np.array([[(drawn[:, k] == i).mean() for k in range(12)] for i in range(12)])
    assert abs(places - 1 / 12).max() < 0.02
    assert (resample.seeded_orders(np.arange(100, 103), 12, 7) == drawn[100:103]).all()
