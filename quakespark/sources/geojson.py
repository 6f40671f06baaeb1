"""GeoJSON feature collections to catalog rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.sources.adapters import finite
from quakespark.sources.tables import settle

COLLECTION = "type string, features array<struct<type: string, id: string, properties: struct<time: bigint, mag: double, place: string>, geometry: struct<type: string, coordinates: array<double>>>>"
#: Features in one collection at most about so many, as pages of a download are.
PAGE = 20_000


def read_collections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(run, id, time_ms, mag, place, lon, lat, depth_km): a row for each feature of all collections below the paths.

    ``run`` is the name of the folder that holds a file. Missing geometry,
    coordinates or properties are null; an empty collection gives no row.
    """
    files = spark.read.schema(COLLECTION).option("multiLine", True).option("recursiveFileLookup", True).json(paths)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    feature = files.select(run.alias("run"), F.explode("features").alias("f"))
    at = lambda i: finite(F.get(F.col("f.geometry.coordinates"), F.lit(i)))
    return feature.select("run", F.col("f.id").alias("id"), F.col("f.properties.time").alias("time_ms"), finite(F.col("f.properties.mag")).alias("mag"), F.col("f.properties.place").alias("place"), at(0).alias("lon"), at(1).alias("lat"), at(2).alias("depth_km"))


def to_catalog(features: DataFrame) -> DataFrame:
    """Catalog rows of features that have a time, magnitude and position; pages may repeat a feature of a run."""
    kept = features.dropna(subset=["time_ms", "mag", "lat", "lon"])
    return kept.dropDuplicates(["run", "id", "time_ms"]).select("run", F.col("id").alias("usgs_id"), F.timestamp_millis("time_ms").alias("time_utc"), (F.col("time_ms") * 1000).alias("time_us"), "lat", "lon", "depth_km", "mag", "place")


def write_collections(catalog: DataFrame, run: Column, path: str, page: int = PAGE) -> None:
    """One folder for each run, with feature collections of about ``page`` features."""
    rows = catalog.withColumn("run", run)
    pages = settle(rows.groupBy("run").agg(F.ceil(F.count("*") / page).alias("pages")), "pages")
    numbered = rows.join(pages, "run").withColumn("page", F.pmod(F.xxhash64("usgs_id"), F.col("pages")))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col("usgs_id").alias("id"),
        F.struct(F.floor(F.col("time_us") / 1000).alias("time"), "mag", "place").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat", "depth_km").alias("coordinates")).alias("geometry"),
    )
    collections = numbered.groupBy("run", "page").agg(F.collect_list(feature).alias("features")).select("run", F.lit("FeatureCollection").alias("type"), "features")
    collections.repartition("run").write.partitionBy("run").option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)
