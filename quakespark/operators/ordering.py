"""Ranks, running sums and dominance counts of ordered rows without one task for a group.

Rows are dealt by ranges of (group, value), from bounds that Spark samples, so a
group with all rows is in as many tasks as any. A task has sums of its own
range; what stands in ranges before it follows from one row for each range.
Ties are added up before they are dealt, so that no range end cuts one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quakespark.sources.tables import settle, small

#: Values that so many rows have are joined by a broadcast of their own; others by a shuffle.
HOT = 100_000
#: Children of a node in the tree of dominance counts, and items that are compared at once.
FAN, CHUNK = 1024, 1024


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which nulls are equal to each other; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums, each over the rows of the group that stand before it; settled.

    Rows should be distinct by (by, order): equal ones come into one range.
    """
    dealt = settle(rows.withColumns({f"_own_{k}": v for k, v in sums.items()}).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    nothing = F.lit(0)
    totals = dealt.groupBy("_range", *by).agg(*[F.sum(f"_own_{k}").alias(f"_all_{k}") for k in sums])
    before = settle(totals.select("_range", *by, *[F.coalesce(F.sum(f"_all_{k}").over(earlier), nothing).alias(f"_before_{k}") for k in sums]), "before")
    local = dealt.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_own_{k}").over(inside), nothing) for k in sums})
    found = _same(local, small(before), ["_range", *by])
    return found.withColumns({k: F.col(f"_in_{k}") + F.col(f"_before_{k}") for k in sums}).drop("_range", *[f"_{p}_{k}" for k in sums for p in ("own", "in", "before")])


def following(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` of the group's rows that stand at or after each; null where there is none."""
    dealt = settle(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy(*by).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # a row for each range of a group
    after = settle(dealt.groupBy("_range", *by).agg(F.min(value).alias("_least")).withColumn("_after", F.min("_least").over(later)).drop("_least"), "after")
    return _same(dealt.withColumn("_in", F.min(value).over(inside)), small(after), ["_range", *by]).withColumn(name, F.least("_in", "_after")).drop("_range", "_in", "_after")


def ranked_values(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, n, below): every value of a group, how many rows have it, and how many a smaller one; settled."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return settle(running(counts, by, [value], {"below": F.col("n")}), "ranked")


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``values`` (keys, n, ...), one row for each key.

    Keys that more than HOT rows have come by a broadcast of their own (there
    are few), so that no task of the shuffled join gets all their rows.
    """
    hot = values.where(F.col("n") > HOT)
    if not hot.limit(1).count():
        return _same(rows, small(values), keys)
    others = [c for c in values.columns if c not in keys]
    marked = _same(rows, small(hot.select(*keys).withColumn("_hot", F.lit(True))), keys, "left")
    often = _same(marked.where("_hot"), small(hot), keys)
    rest = _same(marked.where("_hot IS NULL"), values.where(F.col("n") <= HOT), keys)
    return often.select(*rows.columns, *others).unionByName(rest.select(*rows.columns, *others))


def average_ranks(rows: DataFrame, columns: dict[str, str], by: list[str]) -> DataFrame:
    """``rows`` with a rank (from 1, the mean rank for ties) by group for each column: columns maps a column to the rank's name.

    Values must not be null. Equals the rank by a window over the group; no
    task holds a group.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("_which"), F.col(c).cast("double").alias("_value")) for c in columns])).alias("_s")
    values = ranked_values(rows.select(*by, stacked).select(*by, "_s.*"), "_value", [*by, "_which"])
    out = rows
    for c, name in columns.items():
        own = values.where(F.col("_which") == c).select(*by, F.col("_value").alias("_key"), "n", (F.col("below") + (F.col("n") + 1) / 2).alias(name))
        out = looked_up(out.withColumn("_key", F.col(c).cast("double")), own, [*by, "_key"]).drop("_key", "n")
    return out


def value_at(values: DataFrame, places: DataFrame, value: str) -> DataFrame:
    """``places`` (place, ...) with the value that stands there (from 0) among all rows; ``values`` (value, n, below) are of one group.

    Places are dealt with the values by ranges of position; each has the last
    value that begins at or before it, in its range or else in an earlier one.
    """
    columns = [c for c in places.columns if c != "place"]
    rows = values.select(F.col("below").alias("place"), F.lit(0).alias("_asks"), F.col(value).alias("_has"), F.lit(None).cast(places.select(F.struct(*columns)).schema[0].dataType).alias("_of"))
    asked = places.select("place", F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("_has"), F.struct(*columns).alias("_of"))
    both = rows.unionByName(asked).withColumn("_tie", F.xxhash64("_of"))
    dealt = settle(both.repartitionByRange("place", "_asks", "_tie").withColumn("_range", F.spark_partition_id()), "places")
    upto = Window.partitionBy("_range").orderBy("place", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    last = dealt.groupBy("_range").agg(F.max("_has").alias("_last"))  # values ascend
    before = settle(last.select("_range", F.max("_last").over(earlier).alias("_before")), "before")
    found = dealt.withColumn(value, F.max("_has").over(upto)).join(small(before), "_range").where("_asks = 1")
    return found.select("place", "_of.*", F.coalesce(value, "_before").alias(value))


# ---- dominance of points over many thresholds


def dominance_sums(points: DataFrame, queries: DataFrame, by: str, size: int, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """(by, total): over the queries (by, a, b) of each ``by``, the number of points (x, y) with x < a and y < b.

    x, y, a and b are whole numbers from 0 to ``size``. A tree over x with ``fan``
    children to a node: at each level a query counts the points of its node
    that stand in children before its own and have a smaller y. Points and
    queries are dealt by ranges of (node, y), whatever repeats; a task starts
    from the counts by child of the ranges before it.
    """
    spark, width, found = points.sparkSession, 1, None
    of_type = to_arrow_type(queries.schema[by].dataType)
    while width * fan <= size:
        width *= fan
    while width:
        node = lambda c, w=width: F.floor(F.col(c) / (w * fan)).cast("long")
        child = lambda c, w=width: (F.floor(F.col(c) / w) % fan).cast("int")
        asks = queries.select(node("a").alias("node"), child("a").alias("child"), F.col("b").cast("long").alias("y"), F.lit(0).alias("point"), F.col(by).alias("of")).where("child > 0 AND y > 0")
        stands = points.select(node("x").alias("node"), child("x").alias("child"), F.col("y").cast("long").alias("y"), F.lit(1).alias("point"), F.lit(None).cast(queries.schema[by].dataType).alias("of"))
        both = asks.unionByName(stands).withColumn("tie", F.xxhash64("child", "of", F.monotonically_increasing_id()))
        order = ["node", "y", "point", "tie"]  # a query comes ahead of the points of its y
        dealt = settle(both.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "dominance")
        held = dealt.where("point = 1").groupBy("range", "node", "child").agg(F.count("*").alias("n"))
        spans = dealt.groupBy("node").agg(F.min("range").alias("first"), F.max("range").alias("last")).where("first < last")  # fewer nodes than ranges
        before: dict[tuple[int, int], np.ndarray] = {}
        for r in held.join(small(spans), "node").groupBy("node", "range").agg(F.collect_list(F.struct("child", "n")).alias("own")).orderBy("node", "range").collect():  # fan numbers for each range
            total = np.zeros(fan, dtype=np.int64)
            for child_, n in r["own"]:
                total[child_] = n
            before[r["node"], r["range"]] = total
        starts = _earlier(before)
        shared = spark.sparkContext.broadcast(starts)

        def result(sums: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), of_type), pa.array(list(sums.values()), pa.int64())], names=[by, "total"])

        def count(batches: Iterator[pa.RecordBatch], shared=shared, result=result) -> Iterator[pa.RecordBatch]:
            at, seen, sums = None, np.zeros(fan, dtype=np.int64), {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch.column(c).to_numpy() for c in ("range", "node", "child", "point")]
                of = batch.column("of")
                edges = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
                for part in np.split(np.arange(batch.num_rows), edges):
                    for own in np.split(part, range(chunk, len(part), chunk)):
                        if not len(own):
                            continue
                        where = int(columns[1][own[0]]), int(columns[0][own[0]])
                        if where != at:
                            at, seen = where, _start(shared.value, where, fan)
                        child_, point = columns[2][own], columns[3][own] == 1
                        ask, stand = np.flatnonzero(~point), np.flatnonzero(point)
                        if len(ask):
                            upto = np.concatenate(([0], np.cumsum(seen)))[child_[ask]]
                            near = ((stand[None, :] < ask[:, None]) & (child_[stand][None, :] < child_[ask][:, None])).sum(axis=1)
                            for name, n in zip(of.take(pa.array(own[ask])).to_pylist(), (upto + near).tolist(), strict=True):
                                sums[name] = sums.get(name, 0) + n
                        seen = seen + np.bincount(child_[stand], minlength=fan)
                if len(sums) > 50_000:
                    yield result(sums)
                    sums = {}
            yield result(sums)

        kind = dict(queries.dtypes)[by]
        level = dealt.repartition("range").sortWithinPartitions("range", *order).mapInArrow(count, f"{by} {kind}, total long")
        found = level if found is None else found.unionByName(level)
        width //= fan
    return found.groupBy(by).agg(F.sum("total").alias("total"))


def _earlier(own: dict[tuple[int, int], np.ndarray]) -> dict[int, tuple[list[int], np.ndarray]]:
    """By node its ranges in order and the running totals of their counts."""
    out: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for (node, part), counts in sorted(own.items(), key=lambda e: e[0]):
        ranges, totals = out.setdefault(node, ([], []))
        ranges.append(part)
        totals.append(counts + (totals[-1] if totals else 0))
    return {node: (ranges, np.array(totals)) for node, (ranges, totals) in out.items()}


def _start(earlier: dict, where: tuple[int, int], fan: int) -> np.ndarray:
    """The counts of a node's ranges before one of its ranges."""
    ranges, totals = earlier.get(where[0], ([], None))
    place = int(np.searchsorted(ranges, where[1]))
    return totals[place - 1].copy() if place else np.zeros(fan, dtype=np.int64)


# ---- many weights at once


def weighted_order(rows: DataFrame, value: str, width: int) -> tuple[DataFrame, dict[int, tuple]]:
    """For rows (id, value, times) with arrays of ``width`` weights: (id, range, value, local), settled, and by range what to add to local.

    local + added is the weight of the rows with a smaller value and half that
    of equal ones, for each of the weights: ``complete`` adds it. Rows are
    dealt by ranges of (value, id), so a value that many rows have may lie in
    several ranges. For each range, three rows of weights are collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, below = None, np.zeros(width)
        held: list[np.ndarray] = []
        now, tie, first, ties = None, np.zeros(width), None, {}

        def rows_of(ids: np.ndarray, values: np.ndarray, local: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * width, width), pa.int32()), pa.array(local.reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), part), pa.int32()), pa.array(values), lists], names=["id", "range", "value", "local"])

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                ids = np.concatenate(held)
                for at in range(0, len(ids), CHUNK):
                    own = ids[at : at + CHUNK]
                    yield rows_of(own, np.full(len(own), now), np.tile(below + tie / 2, (len(own), 1)))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("range")[0].as_py()
            v, ids = batch.column("value").to_numpy(), batch.column("id").to_numpy()
            t = batch.column("times").flatten().to_numpy(zero_copy_only=False).reshape(len(v), width).astype(np.float64)
            heads = np.concatenate(([0], np.flatnonzero(v[1:] != v[:-1]) + 1))
            sums, ends = np.add.reduceat(t, heads), np.append(heads[1:], len(v))
            if first is None:
                first = float(v[0])
            k = 0
            if now is not None and v[0] == now:  # goes on with the tie of the batch before
                tie = tie + sums[0]
                held.append(ids[: ends[0]])
                k = 1
            if k < len(heads):
                yield from close()
                if now is not None:
                    ties[now] = tie
                    below = below + tie
                    ties = {x: s for x, s in ties.items() if x == first}
                whole = sums[k:-1]
                if len(whole):
                    starts = below + np.cumsum(whole, axis=0) - whole
                    sizes = ends[k:-1] - heads[k:-1]
                    yield rows_of(ids[heads[k] : ends[-2]], v[heads[k] : ends[-2]], np.repeat(starts + whole / 2, sizes, axis=0))
                    if v[heads[k]] == first:
                        ties[first] = whole[0]
                    below = below + whole.sum(axis=0)
                now, tie, held = float(v[heads[-1]]), sums[-1], [ids[heads[-1] :]]
        yield from close()
        if part is not None:
            ties[now] = tie
            ends_ = np.array([first, now])
            for k, (x, s) in enumerate(zip(ends_, (ties[first], tie), strict=True)):
                yield rows_of(np.array([-1 - k]), np.array([x]), s[None, :])
            yield rows_of(np.array([-3]), np.array([np.nan]), (below + tie)[None, :])

    dealt = rows.select("id", F.col(value).cast("double").alias("value"), "times").repartitionByRange("value", "id").withColumn("range", F.spark_partition_id()).sortWithinPartitions("value", "id")
    local = settle(dealt.mapInArrow(run, "id long, range int, value double, local array<double>"), "weighted")
    parts: dict[int, dict[int, tuple[float, np.ndarray]]] = {}
    for r in local.where("id < 0").collect():
        parts.setdefault(r["range"], {})[r["id"]] = r["value"], np.array(r["local"])
    added, total, order = {}, np.zeros(width), sorted(parts)
    for place, part in enumerate(order):
        (first, _), (last, _), (_, all_) = (parts[part][-k] for k in (1, 2, 3))
        low = sum((parts[p][-2][1] for p in order[:place] if parts[p][-2][0] == first), np.zeros(width))
        high = sum((parts[p][-1][1] for p in order[place + 1 :] if parts[p][-1][0] == last), np.zeros(width))
        added[part] = total.copy(), first, low, last, high
        total += all_
    return local.where("id >= 0"), added


def complete(local: np.ndarray, parts: np.ndarray, values: np.ndarray, added: dict[int, tuple]) -> np.ndarray:
    """``local`` (a row of weights for each row) with what its range lacks."""
    out = local.copy()
    for part in np.unique(parts).tolist():
        base, first, low, last, high = added[part]
        own = parts == part
        out[own] += base
        out[own & (values == first)] -= low / 2  # counted as smaller, but equal
        out[own & (values == last)] += high / 2
    return out
