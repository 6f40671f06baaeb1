"""Tables of other shapes read as an event catalog and as a population grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


#: Rows of a table in a task of what is worked out from it.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, key: str, bound: int = TASK_ROWS) -> DataFrame:
    """``rows`` over tasks of some ``bound`` rows by their key, where reading them leaves twice as many to one task.

    A file of a single row group is one task, however many cores there are.
    The rows of each task are counted from the files' footers.
    """
    counts = rows.select().groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return rows if (counts["most"] or 0) <= 2 * bound else rows.repartition(-(-counts["all"] // bound), key)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a catalog: usgs_id, time_utc, time_us, lat, lon, depth_km, mag, place."""
    spread = lambda low, width, a, b, m: F.lit(low) + F.lit(width) * ((F.col("event_id") * a + F.col("user_id") * b) % m) / F.lit(float(m))
    time = F.col("ts").cast("timestamp")
    return dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").select(
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("usgs_id"),
        time.alias("time_utc"),
        F.unix_micros(time).alias("time_us"),
        spread(22.0, 13.0, 7919, 31, 10007).alias("lat"),
        spread(97.5, 8.0, 104729, 17, 10009).alias("lon"),
        finite(F.get_json_object("props", "$.k").try_cast("double")).alias("depth_km"),
        finite(F.lit(1.0) + F.col("value") / 80.0).alias("mag"),
        F.col("event_type").alias("place"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a population grid: lon, lat, pop."""
    key = F.col("o_orderkey")
    return dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").select(
        (F.lit(97.5) + F.lit(8.0) * ((key * 104729) % 10009) / F.lit(10009.0)).alias("lon"),
        (F.lit(22.0) + F.lit(13.0) * ((key * 7919) % 10007) / F.lit(10007.0)).alias("lat"),
        (F.col("o_totalprice") / 100.0).alias("pop"),
    )
