"""Fits from sums at Chebyshev points against sums over the times, and their gates."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakespark.functions import digests
from quakespark.functions.digests import md5_leading
from quakespark.functions.labels import depth_group
from quakespark.operators import exposure, omori, segments
from quakespark.sources import adapters


def test_sums_are_interpolated_everywhere():
    rng = np.random.default_rng(1)
    for low, high in ((1e-4, 10.0), (0.01, 0.02), (5.0, 9000.0)):
        t = np.exp(rng.uniform(np.log(low), np.log(high), 400))
        sums = np.log(t[None, :] + np.exp(omori.nodes())[:, None]).sum(axis=1)
        u = np.linspace(np.log(omori.C_RANGE[0]), np.log(omori.C_RANGE[1]), 301)
        want = np.log(t[None, :] + np.exp(u)[:, None]).sum(axis=1)
        assert np.abs(omori.interpolated(sums[None, :], u[None, :])[0] - want).max() < 1e-9 * len(t)


def plain_fit(t, low, high):
    t = t[(t >= low) & (t <= high)]
    u, best = np.log(omori.c_grid()), None
    for left in range(omori.ROUNDS, -1, -1):
        logs = np.log(t[None, :] + np.exp(u)[:, None]).sum(axis=1)
        nll, p = omori.best_p(np.exp(u), np.full(len(u), float(len(t))), logs, low, high)
        k = int(np.argmin(nll))
        best = len(t), float(np.exp(u[k])), float(p[k]), float(nll[k])
        u = np.linspace(u[max(k - 1, 0)], u[min(k + 1, len(u) - 1)], omori.STEPS + 1)
    return best


def omori_times(rng, n, c, p, high):
    a, b = c ** (1 - p), (high + c) ** (1 - p)
    return (a + rng.random(n) * (b - a)) ** (1 / (1 - p)) - c


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(9)
    made = {"a": omori_times(rng, 900, 0.05, 1.2, 100.0), "b": omori_times(rng, 60, 0.4, 0.8, 100.0), "c": rng.uniform(0.01, 100.0, 300), "few": omori_times(rng, 15, 0.1, 1.1, 100.0)}
    return pd.concat([pd.DataFrame({"g": g, "t_days": t, "mag": 1.0 + rng.exponential(0.7, len(t))}) for g, t in made.items()])


def test_fits_equal_those_over_the_times(spark, sequences):
    got = {r.g: r for r in omori.fit(spark.createDataFrame(sequences), ["g"], 0.01, 100.0).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, r in got.items():
        n, c, p, nll = plain_fit(sequences[sequences["g"] == g]["t_days"].to_numpy(), 0.01, 100.0)
        assert r.n_events == n and r.nll == pytest.approx(nll, abs=1e-6) and r.p == pytest.approx(p, abs=1e-5) and r.c == pytest.approx(c, rel=1e-4)


def test_sensitivity_is_one_pass_of_fits(spark, sequences):
    got = {(r.mc, r.tmin_days): r for r in omori.sensitivity(spark.createDataFrame(sequences), [1.0, 1.5], [0.01, 0.1], 100.0, least=200).collect()}
    assert set(got) == {(m, s) for m in (1.0, 1.5) for s in (0.01, 0.1)}
    for (mc, low), r in got.items():
        n, _, p, nll = plain_fit(sequences[sequences["mag"] >= mc]["t_days"].to_numpy(), low, 100.0)
        assert r.n_events == n and r.nll == pytest.approx(nll, abs=1e-6) and r.p == pytest.approx(p, abs=1e-5)


def test_draws_do_not_hang_on_how_a_record_is_dealt(spark, sequences, monkeypatch):
    rows = spark.createDataFrame(sequences).withColumnRenamed("g", "record_id")
    fits = omori.fit(rows, ["record_id"], 0.01, 100.0)
    whole = {(r.record_id, r.draw): r.p_boot for r in omori.bootstrap(rows, fits, 0.01, 100.0, 20).collect()}
    monkeypatch.setattr(omori, "PER_TASK", 50)
    dealt = {(r.record_id, r.draw): r.p_boot for r in omori.bootstrap(rows, fits, 0.01, 100.0, 20).collect()}
    assert len(whole) == 60 and dealt == pytest.approx(whole, abs=1e-6)  # sums in another order


def test_digests_are_those_of_hashlib():
    prefixes, suffixes = [b"", b"7|1|a", b"7|10|a", b"x" * 40, b"y" * 54, b"z" * 80], [b"", b"|", b"|ev1", b"|ev23", b"|" + b"e" * 15, "|é".encode()]
    want = [[int(hashlib.md5(p + s).hexdigest()[:8], 16) for s in suffixes] for p in prefixes]
    assert md5_leading(prefixes, suffixes).tolist() == want


def test_digests_of_many_events_are_worked_on_in_full_blocks(monkeypatch):
    sizes = []
    whole = digests._leading
    monkeypatch.setattr(digests, "_leading", lambda words, shape: sizes.append(math.prod(shape)) or whole(words, shape))
    prefixes, suffixes = [f"7|{k}|ev1".encode() for k in range(1, 41)], [f"|ev{i}".encode() for i in range(9_980, 12_000)]
    found = md5_leading(prefixes, suffixes)
    for i, j in ((0, 0), (0, 2019), (8, 19), (39, 20), (39, 2019)):
        assert found[i, j] == int(hashlib.md5(prefixes[i] + suffixes[j]).hexdigest()[:8], 16)
    assert sizes and min(sizes) > digests.AT_ONCE // 3 and max(sizes) <= digests.AT_ONCE  # the few of 20 shorter names are left to hashlib


def test_draws_weigh_digests_in_larger_blocks(spark, sequences, monkeypatch):
    seen = []
    whole = omori._draw_sums
    monkeypatch.setattr(omori, "_draw_sums", lambda *given: seen.append(given) or whole(*given))
    rows = sequences.rename(columns={"g": "record_id"}).assign(usgs_id=lambda f: [f"ev{i}" for i in range(len(f))])
    omori.grid_draws(spark.createDataFrame(rows), 0.01, 100.0, 2, 5)
    assert seen[0][6:] == (omori.DIGEST_BLOCK,) and omori.DIGEST_BLOCK >= 8 * omori.BLOCK


def test_grid_draws_are_grid_fits_of_weighted_rows_in_tasks_by_their_number(spark, sequences, monkeypatch):
    rows = sequences[sequences["g"] != "c"].rename(columns={"g": "record_id"}).assign(usgs_id=lambda f: [f"ev{i}" for i in range(len(f))])
    weighted = []
    for draw in range(1, 7):
        h = [int(hashlib.md5(f"5|{draw}|{r}|{e}".encode()).hexdigest()[:8], 16) / 2**32 for r, e in zip(rows["record_id"], rows["usgs_id"], strict=True)]
        weighted.append(rows.assign(draw=draw, times=np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)]), h, "right")))
    whole = omori.grid_fit(spark.createDataFrame(pd.concat(weighted)).where("times > 0"), ["record_id", "draw"], 0.01, 100.0, weight=F.col("times"))
    want = {(r.record_id, r.draw): r.p for r in whole.collect()}
    monkeypatch.setattr(omori, "PER_TASK", 90)
    drawn = omori.grid_draws(spark.createDataFrame(rows).coalesce(1), 0.01, 100.0, 6, 5)
    assert 12 <= len(want) < 18 and {(r.record_id, r.draw): r.p_boot for r in drawn.collect()} == pytest.approx(want)
    inside = spark.createDataFrame(rows).select("record_id", "usgs_id", "t_days")
    records = inside.groupBy("record_id").agg(F.lit(0.0).alias("u0"), F.count("*").alias("n_events"))
    parts = omori._draw_sums(inside, records, "usgs_id", np.arange(1, 3), lambda record, own: np.ones((2, len(own))), lambda u0: np.ones(1))
    assert parts.rdd.getNumPartitions() == 1 + 3 * len(rows) // 90  # not the few that so small a shuffle would be read in


def test_cells_count_an_event_once_and_give_the_sums_of_its_subgroups(spark):
    rng = np.random.default_rng(3)
    n = 300
    frame = pd.DataFrame({"mainshock_id": rng.choice(["m", "n", "o"], n), "t_days": rng.uniform(0.001, 10, n), "lat": rng.uniform(29, 31, n), "lon": rng.uniform(99, 101, n), "c_lat": 30.0, "c_lon": 100.0, "dist_km": rng.uniform(0, 120, n), "depth_km": rng.uniform(-5, 90, n)})
    events = spark.createDataFrame(frame).withColumns({"depth_km": F.when(F.col("depth_km") > 0, F.col("depth_km")), "lat": F.when(F.col("t_days") > 1, F.col("lat"))})
    rings = spark.createDataFrame([("m", 0.0, 50.0), ("m", 50.0, 100.0), ("n", 0.0, 100.0)], "mainshock_id string, lo double, hi double")  # none about o
    fixed = events.select("mainshock_id", F.lit("depth").alias("subgroup_type"), depth_group(F.col("depth_km"), [0.0, 20.0, 80.0]).alias("subgroup"), "t_days")
    every = segments.expand(events, rings).drop("record_id").unionByName(fixed)
    by, cs = ["mainshock_id", "subgroup_type", "subgroup"], [0.01, 1.0]
    want = {tuple(r[b] for b in by): (r.n_events, r.sums) for r in omori.log_sums(every, by, cs, 0.01, 9.0, 20, 25).collect()}
    own = segments.placed(events, rings, [0.0, 20.0, 80.0])
    assert own.count() == n
    cells = omori.log_parts(own, segments.CELL, cs, 0.01, 9.0)
    got = {tuple(r[b] for b in by): (r.n_events, r.sums) for r in omori.gated(segments.of_cells(cells), by, 2, 20, 25).collect()}
    assert got.keys() == want.keys() and len({k[1:] for k in got}) > 8
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])
    assert all(r.record_id == "|".join(r[b] for b in by) for r in segments.of_cells(cells).collect())


def test_sensitivity_counts_an_event_once(spark, sequences, monkeypatch):
    seen = []
    monkeypatch.setattr(omori, "settle", lambda frame, name: seen.append((name, frame)) or frame)
    omori.sensitivity(spark.createDataFrame(sequences), [1.0, 1.5], [0.01, 0.1], 100.0)
    cells = dict(seen)["cells"]
    assert cells.agg(F.sum("raw")).first()[0] == len(sequences) and cells.count() <= 6


def test_tables_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert rows.rdd.getNumPartitions() == 1 and adapters.dealt(rows, "id", 2500) is rows
    dealt = adapters.dealt(rows, "id", 500)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 5000


def test_sums_of_groups_in_parts(spark, monkeypatch):
    """Each task reads the times once and passes on sums of its groups only, of however many groups."""
    rng = np.random.default_rng(5)
    rows = [(f"m{i % 3}", None if i % 7 == 0 else f"s{i % 7}", float(rng.uniform(0.0, 12.0)), int(rng.integers(0, 4))) for i in range(3000)]
    rows += [("m0", "s1", None, 1), ("few", "s1", 1.0, 1), ("outside", "s1", 11.0, 99)]
    times = spark.createDataFrame(rows, "m string, s string, t_days double, times int").repartition(5)
    cs = [0.001, 0.5, 10.0]
    for most in (4096, 2):
        monkeypatch.setattr(omori, "MOST_GROUPS", most)
        got = {(r.m, r.s): r for r in omori.log_sums(times, ["m", "s"], cs, 0.01, 10.0, 20, 30, F.col("times")).collect()}
        assert len(got) == 21
        for (m, s), r in got.items():
            own = [(t, w) for a, b, t, w in rows if (a, b) == (m, s) and t is not None and 0.01 <= t <= 10.0]
            assert r.n_events == sum(w for _, w in own)
            assert np.allclose(r.sums, [sum(w * np.log(t + c) for t, w in own) for c in cs], rtol=1e-12)


def test_pixels_are_added_up_before_they_meet_subgroups(spark, monkeypatch):
    kept, settle = {}, exposure.settle
    monkeypatch.setattr(exposure, "settle", lambda frame, name: kept.setdefault(name, settle(frame, name)))
    rng = np.random.default_rng(6)
    places = [(float(100 + x), float(28 + y), float(w)) for x, y, w in zip(rng.uniform(-1, 1, 2000), rng.uniform(-1, 1, 2000), rng.uniform(1, 9, 2000), strict=True)]
    groups = [("m", "ring", "0-50km"), ("m", "ring", "50-120km"), ("m", "ring", "20-80km"), ("m", "region", "West_of_ms"), ("m", "depth", "all_depth")]
    wanted = spark.createDataFrame(groups, "mainshock_id string, subgroup_type string, subgroup string")
    centers = spark.createDataFrame([("m", 28.0, 100.0)], "mainshock_id string, c_lat double, c_lon double")
    pixels = spark.createDataFrame(places, "lon double, lat double, pop double")
    got = {r.subgroup: r for r in exposure.subgroup_exposure(pixels, centers, wanted, 120.0).collect()}
    assert kept["cells"].count() <= 6 * 4
    near = [(r.dist_km, r.lon, r.pop) for r in exposure.circle_pixels(pixels, centers, 120.0).collect()]
    inside = {"0-50km": lambda d, x: 0 < d <= 50, "50-120km": lambda d, x: 50 < d <= 120, "20-80km": lambda d, x: 20 < d <= 80, "West_of_ms": lambda d, x: x < 100, "all_depth": lambda d, x: True}
    for name, test in inside.items():
        own = [w for d, x, w in near if test(d, x)]
        assert np.allclose([got[name].pop_sum_subgroup, got[name].pop_mean_subgroup, got[name].pop_max_subgroup], [sum(own), sum(own) / len(own), max(own)])


def test_labels_of_segments_are_written_once(spark):
    events = spark.createDataFrame([("m", float(d), 1.0) for d in range(100)], "mainshock_id string, dist_km double, t_days double").withColumns({c: F.lit(0.0) for c in ("lat", "lon", "c_lat", "c_lon", "depth_km")})
    rings = spark.createDataFrame([("m", 0.0, 50.0), ("m", 50.0, 400.0)], "mainshock_id string, lo double, hi double")
    dealt = segments.expand(events, rings).where("subgroup_type = 'ring'")
    assert {r.subgroup: r["count"] for r in dealt.groupBy("subgroup").count().collect()} == {"0-50km": 50, "50-400km": 50}
    assert "format_number" not in dealt._jdf.queryExecution().optimizedPlan().toString() and "_label" in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_a_records_parts_are_worth_a_task(spark):
    """Sums are passed on for each part of a record and draw, so a part has to be many times."""
    rows = spark.range(60_000).select(F.lit("a").alias("record_id"), (F.col("id") / 6000.0).alias("t_days"), "id")
    records = spark.createDataFrame([("a", 0.0, 60_000)], "record_id string, u0 double, n_events long")
    parts = omori._draw_sums(rows, records, "id", np.arange(3), lambda record, own: np.ones((3, len(own))), lambda u0: np.array([1.0])).toPandas()
    assert parts["draw"].tolist() == [0, 1, 2] and parts["n"].tolist() == [60_000.0] * 3
