"""Catalogs, fits and reports to files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakespark.sources.adapters import finite

CATALOG = "mainshock_id string, mainshock_time_utc timestamp, mainshock_mag double, mainshock_lat double, mainshock_lon double, usgs_id string, time_utc timestamp, lat double, lon double, depth_km double, mag double, place string, t_days double"


def write_catalog(catalog: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet in folders by a bucket of the mainshock, each file in order of mainshock and time."""
    bucket = F.pmod(F.xxhash64("mainshock_id"), F.lit(buckets)).cast("int")
    catalog.withColumn("bucket", bucket).repartition("bucket", "mainshock_id").sortWithinPartitions("bucket", "mainshock_id", "time_utc").write.partitionBy("bucket").parquet(path)


def load_catalog(spark: SparkSession, folder: str, schema: str = CATALOG) -> DataFrame:
    """``catalog.parquet`` below the folder, or else ``catalog.csv``."""
    try:
        found = spark.read.parquet(f"{folder}/catalog.parquet")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.read.option("header", True).schema(schema).csv(f"{folder}/catalog.csv")
    return found.drop("bucket")


def strict_numbers(frame: DataFrame) -> DataFrame:
    """NaN and infinities as null in every double; a column whose name is null-like goes."""
    plain = frame.select(*[finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in frame.schema.fields])
    return plain.drop(*[c for c in plain.columns if c in ("null", "None", "")])


def write_json(frame: DataFrame, path: str) -> None:
    """JSON lines with explicit nulls; timestamps as strings."""
    stamps = {f.name: F.col(f"`{f.name}`").cast("string") for f in frame.schema.fields if isinstance(f.dataType, T.TimestampType)}
    strict_numbers(frame.withColumns(stamps) if stamps else frame).write.option("ignoreNullFields", False).json(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.option("header", True).csv(path)


MAINSHOCKS = "usgs_id string, time_utc string, lat double, lon double, depth_km double, mag double, place string"


def read_mainshocks(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """Mainshocks from files that hold a list of them or a single one (or, with ``lines``, one on each line), as catalog rows; times are UTC."""
    rows = spark.read.schema(MAINSHOCKS).option("multiLine", not lines).json(paths)
    time = F.to_timestamp("time_utc")
    return rows.withColumns({"time_utc": time, "time_us": F.unix_micros(time), **{c: finite(F.col(c)) for c in ("lat", "lon", "depth_km", "mag")}})


def write_mainshocks(mainshocks: DataFrame, path: str) -> None:
    """Mainshocks as JSON lines for read_mainshocks; times as ISO strings in UTC."""
    stamp = F.date_format("time_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    write_json(mainshocks.withColumn("time_utc", stamp).select("usgs_id", "time_utc", "lat", "lon", "depth_km", "mag", "place"), path)


def nested_fits(fits: DataFrame, baseline: dict[str, float] | None = None) -> DataFrame:
    """One row for each section (mainshock or subgroup) and mainshock, with its fits as an array; for write_json.

    ``baseline`` (Mc, tmin_days, tmax_days, ...) is repeated in each row.
    """
    section = F.when(F.col("subgroup_type") == "mainshock", "by_mainshock").otherwise("by_subgroup")
    nested = fits.groupBy(section.alias("section"), "mainshock_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in fits.columns if c != "mainshock_id"]))).alias("fits"))
    return nested if baseline is None else nested.withColumn("baseline", F.struct(*[F.lit(float(v)).alias(k) for k, v in baseline.items()]))


def read_fits(spark: SparkSession, path: str, section: str, fields: str) -> DataFrame:
    """The fits of one section of what nested_fits gave; ``fields`` is the schema of a fit."""
    rows = spark.read.schema(f"section string, mainshock_id string, fits array<struct<{fields}>>").json(path)
    return rows.where(F.col("section") == section).select("mainshock_id", F.explode("fits").alias("fit")).select("mainshock_id", "fit.*")


def write_ordered(frame: DataFrame, order: list, path: str) -> None:
    """A report in order: CSV part files whose names follow the order."""
    frame.orderBy(*order).write.option("header", True).csv(path)


DRAWS = "record_id string, mainshock_id string, subgroup_type string, subgroup string, draw int, p_boot double"


def write_draws(draws: DataFrame, path: str, buckets: int = 64) -> None:
    """The draw table: the finite draws of every record, in folders by a bucket of the record, each file in order of record and draw.

    record_id is mainshock_id|subgroup_type|subgroup; the three are written as
    columns too (those of ``draws``, or else from the record_id).
    """
    parts = F.split("record_id", r"\|", 3)
    named = [F.col(c) if c in draws.columns else F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("mainshock_id", "subgroup_type", "subgroup"))]
    kept = draws.where(finite(F.col("p_boot")).isNotNull()).select("record_id", *named, F.col("draw").cast("int").alias("draw"), F.col("p_boot").cast("double").alias("p_boot"))
    bucket = F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int")
    kept.withColumn("bucket", bucket).repartition("bucket", "record_id").sortWithinPartitions("bucket", "record_id", "draw").write.partitionBy("bucket").parquet(path)


def read_draws(spark: SparkSession, path: str, records: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """The draw table, or only the draws of ``records`` (record_id), from the buckets that they are in.

    Two draws of one number for a record are an error.
    """
    found = spark.read.schema(f"{DRAWS}, bucket int").parquet(path)
    twice = found.groupBy("record_id", "draw").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"Draws that repeat: {[(r['record_id'], r['draw']) for r in twice]}")
    if records is not None:
        own = records.select("record_id", F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
        found = found.join(own, ["record_id", "bucket"], "left_semi")  # by the partition column too: Spark may prune
    return found.drop("bucket")
