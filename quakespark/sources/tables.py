"""Intermediate tables and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with no more rows than this is broadcast; its rows are a few short columns.
BROADCAST_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """A shared folder: below spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def settle(frame: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: it is computed once, and a lost executor does not undo it."""
    path = f"{scratch_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_MADE: dict[tuple, DataFrame] = {}


def made_once(name: str, make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A table that the jobs of a session share: made from a folder and settled when first asked for, and again if the folder's files have changed or its own are gone."""

    def get(spark: SparkSession, folder: str) -> DataFrame:
        key = spark.sparkContext.applicationId, folder, name, _state(spark, folder)
        found = _MADE.get(key)
        if found is None or not _there(found):
            found = _MADE[key] = settle(make(spark, folder), name)
        return found

    return get


def _state(spark: SparkSession, folder: str) -> tuple:
    """Files below a folder, their bytes, and when its entries last changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = system.getContentSummary(path)
    return summary.getFileCount(), summary.getLength(), tuple((entry.getPath().getName(), entry.getModificationTime()) for entry in system.listStatus(path))


def _there(frame: DataFrame) -> bool:
    """Whether the files of a settled table still stand in its folder."""
    spark = frame.sparkSession
    for file in frame.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return False
    return True


def together(grams: DataFrame, by: list[str], arrays: dict[str, int], weight: str | None = None, also: str | None = None) -> DataFrame:
    """Numbers n (``also``: and another column) and arrays of given lengths summed by ``by``, element by element; times a weight if given."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    total = lambda c, m: F.array(*[F.sum(w * F.get(F.col(c), F.lit(i))) for i in range(m)]).alias(c)
    return grams.groupBy(*by).agg(*[F.sum(w * F.col(c)).alias(c) for c in (["n"] if also is None else ["n", also])], *[total(c, m) for c, m in arrays.items()])


def small(frame: DataFrame) -> DataFrame:
    """Marks a side for broadcast if it has at most BROADCAST_ROWS rows; else leaves the join to the optimizer."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame
