"""Exact dedup by tree-merge of sorted digest runs.

Every row goes to one of RUNS runs by a hash of its identifier. A run holds
one row for each digest: the smallest identifier and the number of copies.
Runs then merge in rounds, FAN at a time (run r goes to r // FAN), until one
is left; Spark aggregates ``min(struct)`` by sorting, so each round is a
multiway merge of sorted runs. A digest is verified: rows count as equal only
if SHA-256, length in bytes and an independent 64-bit hash all agree, at every
level. The way back leads down the same tree, and only with digests that have
copies, so a text with a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import SPACE, fresh, matched, row_keys, settle

RUNS, FAN = 64, 8


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def identity(id_col: Column, rid: Column) -> Column:
    """Orders rows by identifier, null last, then by row."""
    return F.struct(id_col.isNull().alias("none"), id_col.alias("id"), rid.alias("rid"))


def elect(rows: DataFrame, keys: list[str], order: Column, runs: int = RUNS, fan: int = FAN) -> DataFrame:
    """The least ``order`` and the number of rows for each key that has several.

    ``rows`` needs a column ``run`` in 0..runs-1. Returns keys, run, first, n:
    one row for each run in which such a key occurs, so that a join by keys
    and run spreads a frequent key over all runs.
    """
    level = rows.select(*keys, "run", order.alias("first")).groupBy(*keys, "run").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    levels, width = [settle(level, "runs")], runs
    while width > 1:
        width = -(-width // fan)
        level = levels[-1].withColumn("run", F.floor(F.col("run") / fan).cast("int")).groupBy(*keys, "run").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        if width == 1:
            level = level.where("n > 1")
        levels.append(settle(level, "runs"))
    won = levels.pop()
    while levels:
        below = levels.pop().select(*keys, F.col("run").alias("own"), F.floor(F.col("run") / fan).cast("int").alias("run"))
        won = below.join(won, [*keys, "run"]).drop("run").withColumnRenamed("own", "run")
    return won.select(*keys, "run", "first", "n")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan: int = FAN) -> DataFrame:
    """One row for each input row: identifier, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space
    became one space. Null text counts as empty, and empty texts are equal to
    each other. The row with the smallest identifier stays; among rows that
    repeat that identifier one stays. A null identifier comes after all
    others: it is kept only if its whole group has none, and keep_id is then
    null. Other columns are ignored. An empty table gives an empty result.
    """
    text, own = normalised(F.col(f"`{text_col}`")), F.col(f"`{id_col}`")
    digests = docs.select(own.alias("id"), text.alias("text")).select(
        "id", F.monotonically_increasing_id().alias("rid"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("check")
    )
    digests = settle(digests.withColumn("run", F.pmod(F.xxhash64("id", "rid"), F.lit(runs)).cast("int")), "digests")
    keys = ["sha", "bytes", "check"]
    won = elect(digests, keys, identity(F.col("id"), F.col("rid")), runs, fan)
    return digests.join(won, [*keys, "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_copies keeps, all columns as they were, whatever their names.

    Rows to drop are what is joined: by identifier and digest. Where a row to
    drop repeats a kept row's identifier and text, one of them is taken. Null
    text counts as empty, a null identifier comes last, and an empty table
    stays empty.
    """
    found = exact_copies(docs, id_col, text_col)
    keys = row_keys(id_col, F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    several = found.where("group_size > 1").select(*row_keys(id_col, F.col("text_sha256")), "kept").toDF("none", "own", "sha", "kept")
    gone = settle(several.groupBy("none", "own", "sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "gone")
    out = matched(docs, keys, gone.where("not kept or n > 1").select("none", "own", "sha"), "left_anti")
    repeated = gone.where("kept and n > 1").select("none", "own", "sha")
    if repeated.limit(1).count():
        again = matched(docs, keys, repeated, "left_semi")
        number = fresh(again, "_number", "_first")
        names = fresh(again, "_none", "_own", "_sha")
        tagged = again.withColumns(dict(zip(names, keys, strict=True))).withColumn(number[0], F.monotonically_increasing_id())
        first = settle(tagged, "again").withColumn(number[1], F.min(number[0]).over(Window.partitionBy(*names)))
        out = out.unionByName(first.where(F.col(number[0]) == F.col(number[1])).drop(*number, *names))
    return out
