"""Ranks, running sums, dominance counts and what is built on them, against plain numpy, with ties across range ends."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakespark.operators import catalog, logo, ordering, resample, stats


@pytest.fixture
def many_ranges(spark):
    """More ranges than tests' few shuffle partitions, none of them merged."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def sample(seed=4, n=700, groups=9, hot=True):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    if hot:
        g[: n // 3] = 0  # a group with a third of the rows and more
    x, y = np.round(rng.normal(size=n), 1), np.round(rng.normal(size=n), 2)
    y = np.where(rng.random(n) < 0.3, x, y)
    return pd.DataFrame({"id": np.arange(n), "g": [f"g{i}" for i in g], "x": x, "y": y})


def test_average_ranks(many_ranges):
    rows = sample(n=3000)
    rows.loc[:1500, "x"] = 0.3  # half the rows tie
    rows["by"] = np.where(rows["id"] % 5 == 0, None, np.where(rows["id"] % 2 == 0, "a", "b"))
    got = ordering.average_ranks(many_ranges.createDataFrame(rows).repartition(7), {"x": "rx", "y": "ry"}, ["by"]).toPandas().sort_values("id")
    by = rows["by"].fillna("null")
    assert np.array_equal(got["rx"], rows.groupby(by)["x"].rank()) and np.array_equal(got["ry"], rows.groupby(by)["y"].rank())


def test_hot_values_by_broadcast(many_ranges, monkeypatch):
    monkeypatch.setattr(ordering, "HOT", 40)
    rows = sample(n=900)
    got = ordering.average_ranks(many_ranges.createDataFrame(rows), {"x": "rx"}, []).toPandas().sort_values("id")
    assert np.array_equal(got["rx"], rows["x"].rank())


def test_a_group_is_dealt_over_many_ranges(many_ranges):
    rows = many_ranges.range(40_000).select(F.lit("all").alias("g"), (F.hash("id") % 30_000).cast("double").alias("x"))
    values = rows.groupBy("g", "x").agg(F.count("*").alias("n"))
    dealt = values.repartitionByRange("g", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 13 and max(r["count"] for r in dealt) < 3 * sum(r["count"] for r in dealt) / 13
    got = ordering.average_ranks(rows, {"x": "rx"}, ["g"]).toPandas().sort_values("x")
    assert np.array_equal(got["rx"].to_numpy(), got["x"].rank().to_numpy())


def test_running_of_groups_with_nulls(many_ranges):
    rows = pd.DataFrame({"g": [None, "a", None, "b", "a", "a"], "v": [3.0, 1.0, 1.0, 9.0, 5.0, 2.0], "w": [1, 2, 3, 4, 5, 6]})
    got = {(r.g, r.v): r.s for r in ordering.running(many_ranges.createDataFrame(rows), ["g"], ["v"], {"s": F.col("w")}).collect()}
    assert got == {(None, 1.0): 0, (None, 3.0): 3, ("a", 1.0): 0, ("a", 2.0): 2, ("a", 5.0): 8, ("b", 9.0): 0}


@pytest.mark.parametrize("fan", [4, 1024])
def test_dominance_sums(many_ranges, fan):
    rng = np.random.default_rng(1)
    points, queries = rng.integers(0, 200, (300, 2)), rng.integers(0, 201, (150, 2))
    points[:100] = 50, 60
    of = [f"q{i % 6}" for i in range(len(queries))]
    want = {}
    for name, (a, b) in zip(of, queries.tolist(), strict=True):
        want[name] = want.get(name, 0) + int(((points[:, 0] < a) & (points[:, 1] < b)).sum())
    got = ordering.dominance_sums(many_ranges.createDataFrame(pd.DataFrame(points, columns=["x", "y"])), many_ranges.createDataFrame(pd.DataFrame(queries, columns=["a", "b"]).assign(g=of)), "g", 200, fan=fan, chunk=7)
    assert {r.g: r.total for r in got.collect()} == want


def spearman(rows):
    if not len(rows):
        return None
    x, y = rows["x"].rank(), rows["y"].rank()
    return None if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1]


@pytest.mark.parametrize("groups", [3, 9, 120])
def test_leave_one_out(many_ranges, groups):
    rows = sample(groups=groups)
    got = {r.omitted: r for r in resample.leave_one_out(many_ranges.createDataFrame(rows), "x", "y", "g").collect()}
    assert set(got) == {"(none)", *rows["g"]}
    for omitted, r in got.items():
        left = rows[rows["g"] != omitted]
        assert r.n == len(left) and r.spearman_rho == pytest.approx(spearman(left), abs=1e-9) and r.pearson_r == pytest.approx(np.corrcoef(left["x"], left["y"])[0, 1], abs=1e-9)


def test_leave_one_out_of_few_rows(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 3.0, 1.0), ("b", 3.0, 4.0), (None, 1.0, 1.0)], "g string, x double, y double")
    got = {r.omitted: r.spearman_rho for r in resample.leave_one_out(one, "x", "y", "g").collect()}
    assert got["a"] is None and got["b"] is None and got["(none)"] == pytest.approx(spearman(pd.DataFrame({"x": [1.0, 2, 3, 3], "y": [2.0, 2, 1, 4]})))
    assert resample.leave_one_out_spearman(one.where("g = 'a'"), "x", "y", "g").collect()[0].omitted == "(none)"


@pytest.mark.parametrize("groups", [2, 60])
def test_train_bins(many_ranges, groups):
    rows = sample(groups=groups)
    got = {r.test_group: (r.q1, r.q2) for r in logo.train_bins(many_ranges.createDataFrame(rows), "x", "g").collect()}
    assert set(got) == set(rows["g"])
    for g, q in got.items():
        assert q == pytest.approx(np.percentile(rows[rows["g"] != g]["x"], [33, 66]), abs=1e-12)
    assert logo.train_bins(many_ranges.createDataFrame(rows[rows["g"] == "g0"]), "x", "g").count() == 0


def test_cluster_bootstrap_by_arrays(many_ranges, monkeypatch):
    monkeypatch.setattr(resample, "REPS_AT_ONCE", 16)
    rows = sample(groups=12)
    spark_rows = many_ranges.createDataFrame(rows)
    draws = resample.cluster_draws(spark_rows.withColumnRenamed("g", "group"), 40, 3).toPandas()
    got = {r.rep: r for r in resample.cluster_bootstrap_correlation(spark_rows, "x", "y", "g", 40, 3).collect()}
    assert len(got) == 40
    for rep, own in draws.groupby("rep"):
        copies = pd.concat([rows[rows["g"] == g] for g, t in zip(own["group"], own["times"], strict=True) for _ in range(t)])
        r = got[rep]
        assert r.n == len(copies) and r.spearman_rho == pytest.approx(spearman(copies), abs=1e-9) and r.pearson_r == pytest.approx(np.corrcoef(copies["x"], copies["y"])[0, 1], abs=1e-9)


def test_correlations_of_groups(many_ranges):
    rows = sample()
    got = {r.g: r for r in stats.correlations(many_ranges.createDataFrame(rows), "x", "y", ["g"]).collect()}
    for g, own in rows.groupby("g"):
        assert got[g].n == len(own) and got[g].spearman_rho == pytest.approx(spearman(own), abs=1e-9)


def plain_declustered(times, window):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= window:
            kept.append(t)
    return kept


def test_dense_catalog_is_declustered_in_many_tasks(many_ranges):
    """An event every few minutes for years is one chain; it equals the plain loop and no task has most of it."""
    rng = np.random.default_rng(6)
    times = np.cumsum(rng.integers(1, 120 * 60, 40_000)) * 1_000_000
    rows = many_ranges.createDataFrame(pd.DataFrame({"usgs_id": [f"e{i}" for i in range(len(times))], "time_us": times})).repartition(5)
    got = catalog.decluster(rows, 2.0).toPandas()
    assert got["time_us"].sort_values().tolist() == plain_declustered(times.tolist(), 2 * catalog.DAY_US)
    read = many_ranges.createDataFrame(pd.DataFrame({"t": times})).repartitionByRange("t").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert read < 2 * len(times) / 13


def test_declustering_of_ties_gaps_and_regions(many_ranges):
    rng = np.random.default_rng(7)
    day = catalog.DAY_US
    frame = pd.DataFrame({"usgs_id": [f"e{i:04d}" for i in range(600)], "time_us": rng.integers(0, 900, 600) * (day // 4), "place": rng.choice(["a", "b", None], 600)})
    frame.loc[frame["time_us"] > 500 * (day // 4), "time_us"] += 40 * day
    rows = many_ranges.createDataFrame(frame)
    got = catalog.decluster(rows, 2.0, 25, region="place").toPandas()
    for place in ("a", "b", None):
        own = frame[frame["place"].isna()] if place is None else frame[frame["place"] == place]
        want = plain_declustered(own["time_us"].tolist(), 2 * day)[:25]
        mine = got[got["place"].isna()] if place is None else got[got["place"] == place]
        assert mine["time_us"].sort_values().tolist() == want
        assert set(mine["usgs_id"]) == {own[own["time_us"] == t]["usgs_id"].min() for t in want}
    assert catalog.decluster(rows.limit(0), 2.0).count() == 0
