"""A population grid as a table of tiles: pixels by the square of the sphere that they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.geo import PIXEL_RADIUS_KM, cell, cells_around
from quakespark.operators.catalog import near_pairs

#: Side of a tile. At most 64,800 tiles of one degree cover the sphere.
TILE_DEGREES = 1.0


def tile(lat: Column, lon: Column, degrees: float = TILE_DEGREES) -> Column:
    """The number of the tile of a point."""
    y, x = cell(lat, lon, degrees)
    return (y + round(90 / degrees)) * round(360 / degrees) + x


def tiles_around(lat: Column, lon: Column, radius_km: float, degrees: float = TILE_DEGREES) -> Column:
    """The numbers of the tiles that a circle may touch."""
    return F.transform(cells_around(lat, lon, radius_km, degrees), lambda c: (c["y"] + round(90 / degrees)) * round(360 / degrees) + c["x"])


def write_grid(pixels: DataFrame, path: str, degrees: float = TILE_DEGREES) -> None:
    """Pixels (lon, lat, pop) as Parquet, a folder for each tile; pixels without a population are left out.

    Rows are dealt by tile ahead of writing, so a tile has a file and not one
    for every task; tiles of very many pixels are dealt to several.
    """
    placed = pixels.where("pop IS NOT NULL").select("lon", "lat", "pop").withColumn("tile", tile(F.col("lat"), F.col("lon"), degrees))
    placed.hint("rebalance", "tile").write.partitionBy("tile").parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, pop and tile; a filter or join on tile reads only the tiles it needs."""
    return spark.read.schema("lon double, lat double, pop double, tile int").parquet(path)


def grid_pixels(grid: DataFrame, centers: DataFrame, radius_km: float, degrees: float = TILE_DEGREES) -> DataFrame:
    """Pixels within the radius of a center (c_lat, c_lon), with dist_km, from the tiles that the circles touch.

    The tiles meet the grid by its partition column: Spark prunes the scan by
    the tiles found at run time. They are no more than cover the sphere.
    """
    needed = centers.select(F.explode(tiles_around(F.col("c_lat"), F.col("c_lon"), radius_km, degrees)).alias("tile")).distinct().where("tile >= 0")
    return near_pairs(grid.join(F.broadcast(needed), "tile", "left_semi").drop("tile"), centers, radius_km, PIXEL_RADIUS_KM)
