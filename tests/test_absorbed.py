"""Absorbed effects against the whole design, the tiled grid, and samples that have only the 50 km population."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakespark.operators import exposure, stats
from quakespark.sources import grid


def study(groups=14, seed=5, rows=9):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        level, mag = rng.normal(), 5.5 + 0.17 * g + rng.random()
        for i in range(rng.integers(1, rows)):
            x, n = rng.normal() + level, rng.integers(25, 900)
            out.append((f"m{g:02d}", ["ring", "depth", "region"][i % 3], mag, int(n), 10 ** (3 + x), 1 + 0.2 * x + 0.1 * level - 0.05 * np.log(n) + 0.1 * rng.normal()))
    return pd.DataFrame(out, columns=["mainshock_id", "subgroup_type", "mainshock_mag", "n_events", "pop_sum_50km", "p"])


def explicit(frame):
    """(term -> coef, se) by the pseudo-inverse of the whole design."""
    levels = sorted(frame["mainshock_id"].unique())[1:]
    x = np.column_stack([np.ones(len(frame)), np.log10(np.maximum(frame["pop_sum_50km"], 1)), frame["mainshock_mag"], np.log(frame["n_events"]), *[(frame["mainshock_id"] == v).astype(float) for v in levels]])
    inverse = np.linalg.pinv(x.T @ x, rcond=1e-13, hermitian=True)
    beta = inverse @ x.T @ frame["p"].to_numpy()
    rest = ((frame["p"] - x @ beta) ** 2).sum()
    dof = max(len(frame) - x.shape[1], 1)
    names = ["const", "log10_pop", "mainshock_mag", "log_n_events", *[f"fe_{v}" for v in levels]]
    return dict(zip(names, zip(beta, np.sqrt(np.diag(inverse) * rest / dof), strict=True), strict=True)), dof, 1 - rest / ((frame["p"] - frame["p"].mean()) ** 2).sum()


@pytest.mark.parametrize("groups", [2, 14, 40])
def test_effects_equal_the_whole_design(spark, groups):
    frame = study(groups)
    want, dof, r2 = explicit(frame)
    got = {r.term: r for r in stats.controlled(spark.createDataFrame(frame).repartition(3), effects=True).collect()}
    assert set(got) == set(want)
    for term, (coef, se) in want.items():
        r = got[term]
        assert r.coef == pytest.approx(coef, abs=1e-8) and r.se == pytest.approx(se, abs=1e-8) and r.dof == dof and r.n == len(frame) and r.r2 == pytest.approx(r2)


def test_effects_of_very_many_groups_stay_a_table(spark):
    rows = spark.range(60_000).selectExpr("concat('m', id div 4) AS mainshock_id", "'ring' AS subgroup_type", "6 + (id div 4) % 7 / 10 AS mainshock_mag", "30 + id % 11 AS n_events", "1000 + (id * 7919) % 10007 AS pop_sum_50km", "1 + (id * 104729) % 101 / 100 AS p")
    found = stats.controlled(rows, effects=True)
    assert found.count() == 4 + 14_999 and found.where("se IS NULL OR isnan(coef)").count() == 0


def test_effects_without_rows(spark):
    assert stats.controlled(spark.createDataFrame(study().iloc[:0], "mainshock_id string, subgroup_type string, mainshock_mag double, n_events int, pop_sum_50km double, p double"), effects=True).count() == 0


def test_only_the_population_within_50_km(spark):
    frame = study().assign(subgroup="a")
    rows = spark.createDataFrame(frame)
    both = spark.createDataFrame(frame.assign(pop_sum_subgroup=frame["pop_sum_50km"]))
    assert stats.analysis_sample(rows).count() == stats.analysis_sample(both).count() == len(frame)
    key = lambda f: sorted((r.term, round(r.coef, 9)) for r in stats.within_fe(f).collect())
    assert key(rows) == key(both) and key(rows)
    with pytest.raises(ValueError, match="pop_sum_subgroup"):
        stats.analysis_sample(rows.drop("pop_sum_50km"))


def test_a_tiled_grid_reads_the_circles_tiles_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    pixels = pd.DataFrame({"lon": rng.uniform(-180, 180, 3300), "lat": rng.uniform(-90, 90, 3300), "pop": rng.uniform(0, 50, 3300)})
    pixels.loc[:3000, "lon"], pixels.loc[:3000, "lat"] = rng.uniform(102, 105, 3001), rng.uniform(29, 32, 3001)
    pixels.loc[::50, "pop"] = None
    rows = spark.createDataFrame(pixels).withColumn("pop", F.when(~F.isnan("pop"), F.col("pop")))
    centers = spark.createDataFrame([("a", 30.0, 103.0), ("b", 31.5, 104.5), ("date line", 0.0, 179.9), ("pole", 89.9, 3.0)], "mainshock_id string, c_lat double, c_lon double")
    path = f"file://{tmp_path}/grid"
    grid.write_grid(rows, path)
    tiles = grid.read_grid(spark, path)
    assert tiles.count() == pixels["pop"].notna().sum() and tiles.select("tile").distinct().count() > 200
    near = grid.grid_pixels(tiles, centers, 50.0)
    assert "dynamicpruning" in near._jdf.queryExecution().executedPlan().toString().lower()
    value = lambda f: sorted(map(str, f.collect()))
    rounded = lambda f: f.select("mainshock_id", *[F.round(c, 6).alias(c) for c in f.columns[1:]])
    assert value(rounded(exposure.buffers(tiles, centers, [10, 50], grid.grid_pixels))) == value(rounded(exposure.buffers(rows, centers, [10, 50])))
