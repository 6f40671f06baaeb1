"""The range join where a small part of the area has most of the points, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakespark.functions.geo import cells_around
from quakespark.operators import catalog

DAY = catalog.DAY_US


def crowd(n=6000, seed=2):
    """90 % of the points in 1 % of the area, many of them at one place; some about the date line and the pole."""
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(20, 40, n), rng.uniform(90, 110, n)
    hot = np.arange(n) < 0.9 * n
    lat[hot], lon[hot] = rng.uniform(30, 32, hot.sum()), rng.uniform(100, 102, hot.sum())
    lat[: n // 5], lon[: n // 5] = 31.25, 101.125
    lat[-60:-30], lon[-60:-30] = rng.uniform(-5, 5, 30), np.where(rng.random(30) < 0.5, rng.uniform(178, 180, 30), rng.uniform(-180, -178, 30))
    lat[-30:], lon[-30:] = rng.uniform(88, 90, 30), rng.uniform(-180, 180, 30)
    return pd.DataFrame({"usgs_id": [f"p{i}" for i in range(n)], "lat": lat, "lon": lon, "time_us": rng.integers(0, 30 * DAY, n)})


def circles(k=40, seed=3):
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(28, 34, k), rng.uniform(97, 105, k)
    lat[0], lon[0], lat[1], lon[1], lat[2], lon[2] = 0.0, 179.5, 89.5, 10.0, 31.25, 101.125
    return pd.DataFrame({"mainshock_id": [f"m{i}" for i in range(k)], "c_lat": lat, "c_lon": lon, "ms_time_us": rng.integers(0, 25 * DAY, k)})


def plain(points, centers, radius, span):
    a, b = np.radians(points["lat"].to_numpy())[:, None], np.radians(centers["c_lat"].to_numpy())[None, :]
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(centers["c_lon"].to_numpy()[None, :] - points["lon"].to_numpy()[:, None]) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h))) <= radius
    if span:
        after = points["time_us"].to_numpy()[:, None] - centers["ms_time_us"].to_numpy()[None, :]
        near &= (after >= 0) & (after <= span)
    i, j = np.nonzero(near)
    return set(zip(points["usgs_id"].to_numpy()[i], centers["mainshock_id"].to_numpy()[j], strict=True))


@pytest.mark.parametrize(("radius", "span"), [(60.0, None), (300.0, 10 * DAY)])
def test_crowded_cells(spark, radius, span):
    points, centers = crowd(), circles()
    got = catalog.near_pairs(spark.createDataFrame(points), spark.createDataFrame(centers), radius, span_us=span, broadcast_rows=0, bound=150)
    assert sorted(got.columns) == sorted([*points.columns, *centers.columns, "dist_km"])
    found = [(r.usgs_id, r.mainshock_id) for r in got.select("usgs_id", "mainshock_id").collect()]
    assert len(found) == len(set(found)) and set(found) == plain(points, centers, radius, span)
    whole = catalog.near_pairs(spark.createDataFrame(points), spark.createDataFrame(centers), radius, span_us=span)
    assert whole.count() == len(found)


def test_no_key_has_many_points(spark):
    points = spark.createDataFrame(crowd()).withColumn("_t", F.lit(0).cast("long"))
    centers = spark.createDataFrame(circles()).withColumn("_t", F.lit(0).cast("long"))
    cells = centers.withColumn("_cell", F.explode(cells_around(F.col("c_lat"), F.col("c_lon"), 60.0, 2.0))).withColumns({"_y": F.col("_cell.y"), "_x": F.col("_cell.x")}).drop("_cell")
    own, leaves = catalog.adapted(points, cells, 60.0, 2.0, bound=150)
    sizes = [r["count"] for r in own.groupBy("_t", "_level", "_y", "_x", "_salt").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 1.5 * 150
    tasks = [r["count"] for r in own.repartition(8, "_t", "_level", "_y", "_x", "_salt").groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 5 * np.median(tasks)
    assert leaves.groupBy("mainshock_id", "_t", "_level", "_y", "_x", "_salt").count().where("count > 1").count() == 0
