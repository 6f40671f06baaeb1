"""Population within circles, rings and half-planes around mainshocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.functions.geo import PIXEL_RADIUS_KM
from quakespark.functions.labels import range_of
from quakespark.operators.catalog import near_pairs
from quakespark.sources.tables import settle, small


#: Ends of a mainshock's rings that a pixel's distance is compared with one by one.
FEW_ENDS = 16


def circle_pixels(pixels: DataFrame, centers: DataFrame, radius_km: float) -> DataFrame:
    """Grid cells with a population, within the radius of a center; distance worked out once for each pair."""
    return near_pairs(pixels.where("pop is not null"), centers, radius_km, PIXEL_RADIUS_KM)


def stats(inside: Column, name: str) -> list[Column]:
    """Sum, mean and maximum of the population where ``inside`` holds; null where nothing does."""
    pop = F.when(inside, F.col("pop"))
    return [F.sum(pop).alias(f"pop_sum_{name}"), F.avg(pop).alias(f"pop_mean_{name}"), F.max(pop).alias(f"pop_max_{name}")]


def buffers(pixels: DataFrame, centers: DataFrame, radii_km: list[int], near_pixels=circle_pixels) -> DataFrame:
    """One row for each center with pop_sum / mean / max for every radius, in one pass at the largest.

    ``near_pixels(pixels, centers, radius)`` finds them; of a tiled grid it is
    ``sources.grid.grid_pixels``.
    """
    near = near_pixels(pixels, centers.select("mainshock_id", "c_lat", "c_lon"), float(max(radii_km)))
    found = near.groupBy("mainshock_id").agg(*[x for r in radii_km for x in stats(F.col("dist_km") <= r, f"{r}km")])
    return centers.select("mainshock_id").join(found, "mainshock_id", "left")


def subgroup_exposure(pixels: DataFrame, centers: DataFrame, subgroups: DataFrame, radius_km: float) -> DataFrame:
    """(mainshock_id, subgroup_type, subgroup, pop_*_subgroup): rings ``(lo, hi]``, half-planes, or the whole circle for depths.

    Subgroups of unknown mainshocks are left out; a ring label that is none gives null.
    """
    low, high = range_of(F.col("subgroup"))
    wanted = settle(subgroups.select("mainshock_id", "subgroup_type", "subgroup").distinct().withColumns({"lo": low, "hi": high}).join(centers.select("mainshock_id"), "mainshock_id"), "wanted")
    # pixels are added up by side and by the ends of rings passed; subgroups are then put together from these few cells
    edges = settle(wanted.groupBy("mainshock_id").agg(F.collect_set(F.when(F.col("subgroup_type") == "ring", F.array("lo", "hi"))).alias("_rings")).select("mainshock_id", F.array_sort(F.array_distinct(F.filter(F.flatten("_rings"), lambda x: x.isNotNull()))).alias("edges")), "edges")
    near = circle_pixels(pixels, centers.select("mainshock_id", "c_lat", "c_lon"), radius_km).join(small(edges), "mainshock_id")
    most = edges.agg(F.max(F.size("edges"))).first()[0] or 0
    # a sum is compiled, a filter of an array is not
    step = sum((F.coalesce((F.get("edges", F.lit(i)) < F.col("dist_km")).cast("int"), F.lit(0)) for i in range(most)), F.lit(0)) if most <= FEW_ENDS else F.size(F.filter("edges", lambda e: e < F.col("dist_km")))
    sides = {"east": F.col("lon") >= F.col("c_lon"), "west": F.col("lon") < F.col("c_lon"), "north": F.col("lat") >= F.col("c_lat"), "south": F.col("lat") < F.col("c_lat")}
    cells = near.groupBy("mainshock_id", step.alias("step"), *[c.alias(k) for k, c in sides.items()]).agg(F.sum("pop").alias("pop"), F.count("pop").alias("n"), F.max("pop").alias("most"))
    met = settle(cells, "cells").join(small(edges), "mainshock_id").join(small(wanted), "mainshock_id")
    name = F.col("subgroup")
    half = F.when(name.contains("East_of"), F.col("east")).when(name.contains("West_of"), F.col("west")).when(name.contains("North_of"), F.col("north")).when(name.contains("South_of"), F.col("south")).otherwise(True)
    at = lambda end: F.array_position("edges", F.col(end))
    inside = F.when(F.col("subgroup_type") == "ring", (F.col("step") >= at("lo")) & (F.col("step") < at("hi"))).when(F.col("subgroup_type") == "region", half).otherwise(True)
    keys = ["mainshock_id", "subgroup_type", "subgroup"]
    found = met.where(inside).groupBy(*keys).agg(F.sum("pop").alias("pop_sum_subgroup"), (F.sum("pop") / F.sum("n")).alias("pop_mean_subgroup"), F.max("most").alias("pop_max_subgroup"))
    return wanted.select(*keys).join(found, keys, "left")
