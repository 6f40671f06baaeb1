"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word definitions here: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast when it has no more rows than this; each such
#: side has a few short columns, so this is some tens of MB at most.
BROADCAST_ROWS = 400_000
#: ... where a query has many such joins one after the other: the driver builds
#: each side, and keeps it until its garbage is collected.
CHAIN_ROWS = 100_000
#: Rows of an Arrow batch between Spark and Python: texts may be long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a temporary one where that is unset.

    A temporary folder is one machine's, so it is taken only in local mode.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quakespark-{context.applicationId}"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batches to ``rows`` rows, so that a Python worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def frees(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that gives freed memory back to the system at the end.

    Python workers outlive their tasks. What the allocators keep of one
    stage's batches would count for the executor through all later ones.
    """

    @functools.wraps(make)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a query that runs in here when the query has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def settle(frame: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks it ran,
    and columns such as row numbers stay as they were first made. The shuffle
    files behind the table go once it is written.
    """
    spark = frame.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more: what was made of them has been settled itself."""
    for frame in frames:
        spark, files = frame.sparkSession, frame.inputFiles()
        if files and f"/quakespark-{spark.sparkContext.applicationId}/" in files[0]:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``frame`` is called so."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def few(frame: DataFrame, most: int) -> bool:
    """Whether a table that is cheap to count has no more rows than ``most``."""
    return frame.limit(most + 1).count() <= most


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salt: int = 16, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side of few rows for each key: broadcast if it is small, else by salted keys.

    ``right`` should be cheap to count (settled). Beyond ``most`` rows each of
    them is repeated for every salt, so that a key with a third of the left
    rows is dealt over ``salt`` tasks; salt 1 is for keys that the left side
    has once. Spark takes the size of the files for that of the repeated rows
    and would broadcast them through the driver, hence the hint.
    """
    if few(right, most):
        return left.join(F.broadcast(right), on, how)
    if salt == 1:
        return left.join(right.hint("merge"), on, how)
    (name,) = fresh(left, "_salt")
    salted = right.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
    every = [F.col(f"`{c}`") for c in left.columns]
    return left.withColumn(name, F.pmod(F.xxhash64(*every), F.lit(salt)).cast("int")).join(salted, [*on, name], how).drop(name)


def matched(docs: DataFrame, keys: list[Column], found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (left_semi, left_anti, inner) with ``found`` by non-null keys, its first columns.

    All columns of ``docs`` come back as they were, whatever their names;
    further columns of ``found`` follow. Rows of ``found`` are short, so the
    documents are shuffled only where it has too many to be broadcast.
    """
    names = fresh(docs, *[f"_key{i}" for i in range(len(keys))])
    tagged = docs.withColumns(dict(zip(names, keys, strict=True)))
    renamed = found.withColumnsRenamed(dict(zip(found.columns[: len(keys)], names, strict=True)))
    return join_small(tagged, renamed, names, how).drop(*names)


def row_keys(id_col: str, digest: Column) -> list[Column]:
    """Keys of a row, none of them null: whether it has an identifier, that identifier, and a digest of its text."""
    own = F.col(f"`{id_col}`")
    return [own.isNull(), F.coalesce(own.cast("string"), F.lit("")), digest]


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")
