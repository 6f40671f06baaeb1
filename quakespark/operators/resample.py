"""Resampling by hashes: each draw depends on (seed, repetition, key) alone, not on order or partitions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.operators.ordering import complete, dominance_sums, looked_up, ranked_values, running, weighted_order
from quakespark.operators.stats import demeaned, fe_terms, gram, independent, unpack
from quakespark.sources.tables import settle, small, together


def draw_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def draw_integer(*parts: Column) -> Column:
    """32 bits of the draw's hash."""
    return F.conv(F.substring(draw_hash(*parts), 1, 8), 16, 10).cast("long")


def repetitions(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))


def leave_one_out(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Correlations without each group, and of all rows as ``(none)``: omitted, n, pearson_r, spearman_rho."""
    return leave_one_out_pearson(rows, x, y, group).join(leave_one_out_spearman(rows, x, y, group), "omitted")


def leave_one_out_spearman(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """omitted, spearman_rho without each group and, as ``(none)``, of all, from one ranking of all rows.

    A row's rank without a group is its rank less c, the group's rows below it
    and half of those equal to it. Of the sums that the correlation needs,

    - squares of ranks follow from the numbers of ties,
    - rank times rank and rank times c from sums over the group's own rows: c
      of y summed with the ranks of x is, for each row of the group, the ranks
      of x above it in y, a running sum over all rows,
    - c of x times c of y, over all rows, from dominance counts: for pairs of
      the group's rows, the rows above one in x and above the other in y. A
      group whose pairs outnumber the rows (there are few) has its c of every
      row instead, all such groups at once as arrays.
    """
    kept = rows.select(F.col(group).cast("string").alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    kept = settle(kept.withColumn("id", F.monotonically_increasing_id()), "kept")
    size = kept.count()
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("value"), scope.alias("scope")) for c in ("x", "y") for scope in (F.lit(None).cast("string"), F.col("g"))])).alias("s")
    values = ranked_values(kept.select(stacked).select("s.*"), "value", ["which", "scope"])
    own = kept
    for c in ("x", "y"):  # below and equal among all rows (b, e), and in the group (gb, ge)
        whole = values.where((F.col("which") == c) & F.col("scope").isNull()).select(F.col("value").alias(c), "n", F.col("below").alias(f"b{c}"), F.col("n").alias(f"e{c}"))
        inside = values.where((F.col("which") == c) & F.col("scope").isNotNull()).select(F.col("scope").alias("g"), F.col("value").alias(c), "n", F.col("below").alias(f"gb{c}"), F.col("n").alias(f"ge{c}"))
        own = looked_up(looked_up(own, whole, [c]).drop("n"), inside, ["g", c]).drop("n")
    rank, half = (lambda b, e: F.col(b) + (F.col(e) + 1) / 2), (lambda b, e: F.col(b) + F.col(e) / 2)
    own = settle(own.withColumns({"rx": rank("bx", "ex"), "ry": rank("by", "ey"), "cx": half("gbx", "gex"), "cy": half("gby", "gey")}), "ranked_rows")
    above = own.select("id", "g", "x", "y")
    for c, other in (("x", "ry"), ("y", "rx")):  # the other ranks of the rows above, half of those equal
        sums = own.groupBy(c).agg(F.sum(other).alias("own"), F.count("*").alias("n"))
        after = running(sums, [], [c], {"before": F.col("own")})
        above = looked_up(above, settle(after.select(c, "n", (F.lit(size * (size + 1) / 2) - F.col("before") - F.col("own") / 2).alias(f"over_{c}")), "above"), [c]).drop("n")
    cube = lambda n: n * n * n - n
    lost = lambda c: F.sum((cube((F.col(f"e{c}") - F.col(f"ge{c}")).cast("double")) - cube(F.col(f"e{c}").cast("double"))) / F.col(f"ge{c}"))
    sums = own.join(above.select("id", "over_x", "over_y"), "id").groupBy("g").agg(
        F.count("*").alias("m"), F.sum(F.col("rx") * F.col("ry")).alias("rr"), F.sum("over_y").alias("ry_all"), F.sum("over_x").alias("rx_all"),
        F.sum(F.col("rx") * F.col("cy")).alias("ry_own"), F.sum(F.col("ry") * F.col("cx")).alias("rx_own"), F.sum(F.col("cx") * F.col("cy")).alias("cc_own"),
        F.sum(F.col("rx") - 0.5).alias("sx"), F.sum(F.col("ry") - 0.5).alias("sy"), lost("x").alias("tx"), lost("y").alias("ty"),
    )
    sums = settle(sums, "group_sums")
    few = sums.where(F.col("m") * F.col("m") <= size).select("g")
    many = sorted(r["g"] for r in sums.where(F.col("m") * F.col("m") > size).select("g").collect())  # at most the root of the rows
    corners = own.join(small(few), "g", "left_semi").select("g", "bx", "by")
    corners = settle(corners, "corners")
    at = lambda c, name: F.explode(F.array(F.col(c), F.col(c) + 1)).alias(name)
    queries = corners.select("g", at("bx", "a")).join(corners.select("g", at("by", "b")), "g")
    counted = dominance_sums(own.select(F.col("bx").alias("x"), F.col("by").alias("y")), queries, "g", size)
    counted = sums.join(counted, "g", "left").where(F.col("m") * F.col("m") <= size).select("g", (F.col("m") * F.col("m") * float(size) - F.col("m") * (F.col("sx") + F.col("sy")) + F.coalesce("total", F.lit(0)) / 4).alias("cc"))
    if many:
        counted = counted.unionByName(_dominated_by(own, many))
    total = own.agg(F.sum(F.col("rx") * F.col("ry")).alias("all_rr"))  # one row
    ties = values.where("scope IS NULL").agg(*[F.coalesce(F.sum(F.when(F.col("which") == c, cube(F.col("n").cast("double")))), F.lit(0.0)).alias(f"all_t{c}") for c in ("x", "y")])  # one row
    one = total.crossJoin(ties)
    groups = sums.join(counted, "g").crossJoin(F.broadcast(one)).select(
        F.col("g").alias("omitted"), (F.lit(float(size)) - F.col("m")).alias("n"), (F.col("all_tx") + F.col("tx")).alias("tx"), (F.col("all_ty") + F.col("ty")).alias("ty"),
        (F.col("all_rr") - F.col("rr") - (F.col("ry_all") - F.col("ry_own")) - (F.col("rx_all") - F.col("rx_own")) + F.col("cc") - F.col("cc_own")).alias("xy"),
    )
    whole = one.select(F.lit("(none)").alias("omitted"), F.lit(float(size)).alias("n"), F.col("all_tx").alias("tx"), F.col("all_ty").alias("ty"), F.col("all_rr").alias("xy"))
    n = F.col("n")
    spread = lambda t: (n * n * n - n - F.col(t)) / 12
    moves = (spread("tx") > 0) & (spread("ty") > 0)
    r = F.try_divide(F.col("xy") - n * (n + 1) * (n + 1) / 4, F.sqrt(spread("tx") * spread("ty")))
    return groups.unionByName(whole).where("n > 0").select("omitted", F.when(moves, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).alias("spearman_rho"))


def _dominated_by(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(g, cc): for each of a few groups, the sum over all rows of c of x times c of y (see above)."""
    k, place = len(groups), F.broadcast(rows.sparkSession.createDataFrame([(g, i) for i, g in enumerate(groups)], "g string, place int"))
    times = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.coalesce("place", F.lit(-1))).cast("int"))
    weighed = settle(rows.join(place, "g", "left").select("id", "x", "y", times.alias("times")), "marks")

    def add(x: np.ndarray, y: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        return (x * y).sum(axis=0)

    found = weighted_sums(weighed, k, 1, add)
    return rows.sparkSession.createDataFrame([(g, float(v)) for g, v in zip(groups, found[0], strict=True)], "g string, cc double")


def weighted_sums(rows: DataFrame, width: int, outputs: int, add, carry: tuple[str, ...] = ()) -> np.ndarray:
    """Sums over rows (id, x, y, times) of add(c of x, c of y, batch): ``outputs`` rows of ``width`` numbers.

    c is, for each of the ``width`` weights in times, the weight of the rows
    with a smaller value and half that of equal ones (see weighted_order).
    ``carry`` names further columns of rows that the batch has.
    """
    (by_x, add_x), (by_y, add_y) = weighted_order(rows, "x", width), weighted_order(rows, "y", width)
    both = by_x.select("id", F.col("range").alias("px"), F.col("value").alias("x"), F.col("local").alias("lx")).join(by_y.select("id", F.col("range").alias("py"), F.col("value").alias("y"), F.col("local").alias("ly")), "id")
    if carry:
        both = both.join(rows.select("id", *carry), "id")
    shared = rows.sparkSession.sparkContext.broadcast((add_x, add_y))  # three rows of weights for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, (add_x, add_y) = None, shared.value
        for batch in batches:
            if batch.num_rows:
                column = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
                lists = lambda c: batch.column(c).flatten().to_numpy().reshape(-1, width)  # noqa: B023, E731
                own = np.atleast_2d(add(complete(lists("lx"), column("px"), column("x"), add_x), complete(lists("ly"), column("py"), column("y"), add_y), batch))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(outputs)), "sums": pa.array(total.tolist(), pa.list_(pa.float64()))})

    out = np.zeros((outputs, width))
    long = both.mapInArrow(run, "part long, sums array<double>").select("part", F.posexplode("sums").alias("at", "v")).groupBy("part", "at").agg(F.sum("v").alias("v"))
    for r in long.collect():  # outputs * width numbers
        out[r["part"], r["at"]] = r["v"]
    return out


def leave_one_out_pearson(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """omitted, n, pearson_r without each group and, as ``(none)``, of all: from the groups' moments alone."""
    kept = rows.select(F.col(group).cast("string").alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    means = kept.agg(F.avg("_x"), F.avg("_y")).first()
    u, v = (F.col(c) - float(m or 0.0) for c, m in zip(("_x", "_y"), means, strict=True))
    names = ("n", "u", "v", "uu", "vv", "uv")
    sums = [F.sum(e).alias(k) for k, e in zip(names, (F.lit(1.0), u, v, u * u, v * v, u * v), strict=True)]
    own = settle(kept.groupBy("_g").agg(*sums), "moments")
    total = own.agg(*[F.sum(k).alias(f"all_{k}") for k in names])  # one row
    less = own.crossJoin(F.broadcast(total)).select(F.col("_g").alias("omitted"), *[(F.col(f"all_{k}") - F.col(k)).alias(k) for k in names], *[F.col(f"all_{k}") for k in ("uu", "vv")])
    whole = total.select(F.lit("(none)").alias("omitted"), *[F.col(f"all_{k}").alias(k) for k in names], "all_uu", "all_vv")
    spread = lambda c: F.col(f"{c}{c}") - F.col(c) * F.col(c) / F.col("n")
    moves = (spread("u") > 1e-12 * F.col("all_uu")) & (spread("v") > 1e-12 * F.col("all_vv"))
    r = F.try_divide(F.col("uv") - F.col("u") * F.col("v") / F.col("n"), F.sqrt(spread("u") * spread("v")))
    return less.unionByName(whole).where("n > 0").select("omitted", F.col("n").cast("long").alias("n"), F.when(moves, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).alias("pearson_r"))


def cluster_draws(groups: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, group, times): as many groups as there are, drawn with replacement, for each repetition.

    ``groups`` (group) is a level set; slot s of a repetition takes the group
    whose place in order is the slot's hash modulo their number.
    """
    order = Window.orderBy("group")  # the groups only
    placed = groups.select("group").distinct().withColumn("place", F.row_number().over(order) - 1)
    n = placed.count()
    slots = repetitions(placed.select(F.col("place").alias("slot")), reps)
    drawn = slots.withColumn("place", draw_integer(F.lit(seed), F.col("rep"), F.col("slot")) % max(n, 1))
    return drawn.groupBy("rep", "place").agg(F.count("*").alias("times")).join(small(placed), "place").select("rep", "group", "times")


#: Repetitions whose multiplicities a row carries at once.
REPS_AT_ONCE = 512


def cluster_bootstrap_correlation(rows: DataFrame, x: str, y: str, group: str, reps: int, seed: int) -> DataFrame:
    """(rep, n, pearson_r, spearman_rho) with whole groups drawn; repeated groups' rows repeat.

    A row has its group's multiplicities as an array, one for each repetition.
    Ranks are weighted by them: all repetitions come from running sums of these
    arrays over one order of the rows, and no row is copied.
    """
    spark = rows.sparkSession
    kept = settle(rows.select(F.col(group).alias("group"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().withColumn("id", F.monotonically_increasing_id()), "kept")
    draws = settle(cluster_draws(kept, reps, seed), "draws")
    means = kept.agg(F.avg("x"), F.avg("y")).first()
    shift = [float(m or 0.0) for m in means]
    parts = [_bootstrapped(kept, draws.where(F.col("rep").between(low, low + REPS_AT_ONCE - 1)), low, min(REPS_AT_ONCE, reps - low + 1), shift) for low in range(1, reps + 1, REPS_AT_ONCE)]
    found = [r for part in parts for r in part if r[1]]
    return spark.createDataFrame(found, "rep int, n long, pearson_r double, spearman_rho double")


def _bootstrapped(kept: DataFrame, draws: DataFrame, low: int, width: int, shift: list[float]) -> list[tuple]:
    drawn = draws.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("rep", F.col("times").cast("int")))).alias("own"))  # width entries at most
    times = F.transform(F.sequence(F.lit(low), F.lit(low + width - 1)), lambda r: F.coalesce(F.try_element_at("own", r), F.lit(0)))
    weighed = settle(kept.join(small(settle(drawn.select("group", times.alias("times")), "times")), "group").select("id", "x", "y", "times"), "weighed")

    def add(cx: np.ndarray, cy: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        t = batch.column("times").flatten().to_numpy(zero_copy_only=False).reshape(cx.shape)
        u, v = (batch.column(c).to_numpy()[:, None] - m for c, m in zip(("x", "y"), shift, strict=True))
        pairs = [np.ones_like(u), u, v, u * u, v * v, u * v]
        return np.stack([*[(t * p).sum(axis=0) for p in pairs], *[(t * p).sum(axis=0) for p in (cx, cy, cx * cx, cy * cy, cx * cy)]])

    found = weighted_sums(weighed, width, 11, add, ("times",))
    out = []
    for rep in range(width):
        n = found[0, rep]
        out.append((low + rep, int(round(n)), *[_correlation(n, *sums) for sums in (found[1:6, rep], found[6:, rep])]))
    return out


def _correlation(n: float, u: float, v: float, uu: float, vv: float, uv: float) -> float | None:
    """From sums; None where either does not vary."""
    if n <= 0:
        return None
    a, b = uu - u * u / n, vv - v * v / n
    if a <= 1e-12 * max(uu, 1e-300) or b <= 1e-12 * max(vv, 1e-300):
        return None
    return float(min(1.0, max(-1.0, (uv - u * v / n) / (a * b) ** 0.5)))


def group_grams(rows: DataFrame, columns: list[str], group: str, by: list[str] | None = None) -> DataFrame:
    """(by, group, n, sums, products) of columns demeaned by group."""
    keys = [*(by or []), group]
    return gram(demeaned(rows, columns, keys), columns, keys)


def first_slope(matrix: np.ndarray) -> float | None:
    """The first term's coefficient from products of demeaned (terms..., outcome); None where it has no variation."""
    inner, own = matrix[1:-1, 1:-1], matrix[1:-1, -1]
    kept = independent(inner)
    if not kept or kept[0] != 0:
        return None
    return float(np.linalg.lstsq(inner[np.ix_(kept, kept)], own[kept], rcond=None)[0][0])


def first_slopes(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> list[float | None]:
    """first_slope for many rows at once: the other terms are swept out together, unclear cases go one by one."""
    k = sums.shape[1]
    m = np.zeros((len(n), k, k))
    i, j = np.triu_indices(k)
    m[:, i, j] = products
    m[:, j, i] = products
    size = m[:, np.arange(k), np.arange(k)].copy()
    unclear = size[:, 0] <= 0
    for t in range(1, k - 1):
        pivot = m[:, t, t]
        unclear |= (pivot <= 1e-7 * size[:, t]) & (size[:, t] > 0)
        safe = np.where(pivot > 0, pivot, np.inf)
        m = m - m[:, :, t, None] * m[:, None, t, :] / safe[:, None, None]
    unclear |= m[:, 0, 0] <= 1e-7 * size[:, 0]
    own = m[:, 0, -1] / np.where(unclear, 1.0, m[:, 0, 0])
    return [first_slope(unpack(n[r], sums[r], products[r])) if unclear[r] else float(own[r]) for r in range(len(n))]


def slopes(sums: DataFrame, by: list[str]) -> DataFrame:
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = first_slopes(batch["n"].to_numpy(float), np.stack(batch["sums"].to_numpy()), np.stack(batch["products"].to_numpy()))
                yield batch[by].assign(slope=pd.array(found, dtype="Float64"))

    kinds = dict(sums.dtypes)
    return sums.select(*by, "n", "sums", "products").mapInPandas(solve, ", ".join(f"{b} {kinds[b]}" for b in by) + ", slope double")


def _lengths(k: int) -> dict[str, int]:
    return {"sums": k, "products": k * (k + 1) // 2}


def cluster_bootstrap_fe(sample: DataFrame, reps: int, seed: int, outcome: str = "p", terms: list[str] | None = None) -> DataFrame:
    """(rep, slope): the fixed-effects exposure slope with whole mainshocks drawn, each copy with an effect of its own."""
    rows, names = fe_terms(sample)
    columns = [*(terms or names), outcome]
    grams = settle(group_grams(rows, columns, "mainshock_id"), "grams")
    draws = cluster_draws(grams.select(F.col("mainshock_id").alias("group")), reps, seed).withColumnRenamed("group", "mainshock_id")
    return slopes(together(draws.join(small(grams), "mainshock_id"), ["rep"], _lengths(len(columns)), "times"), ["rep"])


def permute_within(rows: DataFrame, value: str, group: str, key: str, reps: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by, rep, group, key, value): the values of a group's rows dealt to them anew in each repetition."""
    keys = [*(by or []), group]
    placed = rows.select(*keys, key, value).withColumn("_to", F.row_number().over(Window.partitionBy(*keys).orderBy(key)))
    given = repetitions(placed, reps).withColumn("_to", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy(draw_hash(F.lit(seed), F.col("rep"), F.col(key)), key))).select(*keys, "rep", "_to", value)
    return given.join(placed.drop(value), [*keys, "_to"]).select(*keys, "rep", key, value)


def permutation_sums(sample: DataFrame, reps: int, seed: int, outcome: str = "p", terms: list[str] | None = None, each: bool = False, value: str = "log10_pop") -> tuple[DataFrame, int]:
    """Sums of products (see gram) of (exposure, other terms..., outcome), demeaned by mainshock, for each repetition; and how many columns they are of.

    Repetition 0 is as observed; in the others a mainshock's exposures are
    dealt to its rows in the order of hashes, as in permute_within. Rows are
    shuffled once, by mainshock; a task then adds up all repetitions, so
    ``reps`` rows leave it and not ``reps`` copies of its rows. With ``each``
    the sums stay apart by mainshock.
    """
    rows, names = fe_terms(sample)
    columns = [value, *[t for t in (terms or names) if t != value], outcome]
    k = len(columns)
    kept = rows.dropna(subset=columns).select("mainshock_id", "record_id", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])

    def of_group(own: pd.DataFrame) -> tuple[int, np.ndarray]:
        own = own.sort_values("record_id")
        v = own[[f"v{i}" for i in range(k)]].to_numpy(float)
        v = v - v.mean(axis=0)
        keys = own["record_id"].tolist()
        orders = np.empty((reps + 1, len(keys)), dtype=np.int64)
        orders[0] = np.arange(len(keys))
        for rep in range(1, reps + 1):
            marks = [hashlib.md5(f"{seed}|{rep}|{key}".encode()).hexdigest() for key in keys]
            orders[rep] = sorted(range(len(keys)), key=lambda i: (marks[i], keys[i]))  # noqa: B023
        i, j = np.triu_indices(k)
        out = np.tile((v.T @ v)[i, j], (reps + 1, 1))
        out[:, 1:k] = v[orders, 0] @ v[:, 1:]
        return len(keys), out

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows_of(name, n: int, products: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"mainshock_id": name, "rep": np.arange(reps + 1, dtype=np.int32), "n": float(n), "sums": [np.zeros(k)] * (reps + 1), "products": list(products)})

        held: list[pd.DataFrame] = []
        total_n, total = 0, np.zeros((reps + 1, k * (k + 1) // 2))

        def close() -> tuple[int, np.ndarray]:
            return of_group(pd.concat(held)) if held else (0, 0.0)

        for batch in batches:
            for name, own in batch.groupby("mainshock_id", sort=False):
                if held and held[0]["mainshock_id"].iloc[0] != name:
                    n, products = close()
                    if each:
                        yield rows_of(held[0]["mainshock_id"].iloc[0], n, products)
                    total_n, total, held = total_n + n, total + products, []
                held.append(own)
        n, products = close()
        if each and held:
            yield rows_of(held[0]["mainshock_id"].iloc[0], n, products)
        if not each and (held or total_n):
            yield rows_of("", total_n + n, total + products)

    dealt = kept.repartition("mainshock_id").sortWithinPartitions("mainshock_id")
    sums = dealt.mapInPandas(add, "mainshock_id string, rep int, n double, sums array<double>, products array<double>")
    return (sums if each else together(sums, ["rep"], _lengths(k))), k


def permutation_slopes(sample: DataFrame, reps: int, seed: int, outcome: str = "p", terms: list[str] | None = None) -> DataFrame:
    """(rep, slope): rep 0 is the observed slope, others have the exposure permuted within mainshocks."""
    return slopes(permutation_sums(sample, reps, seed, outcome, terms)[0], ["rep"])


def permutation_slopes_without_each(sample: DataFrame, reps: int, seed: int, outcome: str = "p") -> DataFrame:
    """(omitted, rep, slope): permutation_slopes without each mainshock, from the totals less its own sums."""
    sums, k = permutation_sums(sample, reps, seed, outcome, each=True)
    sums = settle(sums, "permuted")
    total = settle(together(sums, ["rep"], _lengths(k)), "totals").withColumnsRenamed({c: f"all_{c}" for c in ("n", "sums", "products")})
    minus = lambda c: F.zip_with(F.col(f"all_{c}"), F.col(c), lambda a, b: a - b).alias(c)
    less = sums.join(small(total), "rep").select(F.col("mainshock_id").alias("omitted"), "rep", (F.col("all_n") - F.col("n")).alias("n"), minus("sums"), minus("products"))
    return slopes(less.where("n > 0"), ["omitted", "rep"])


def permutation_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """observed, n_perm, two-sided p (hits + 1) / (n + 1), and the null's mean and 2.5 and 97.5 % points."""
    own = F.max(F.when(F.col("rep") == 0, F.col("slope"))).over(Window.partitionBy(*by))
    null = F.when(F.col("rep") > 0, F.col("slope"))
    hit = F.when(F.col("rep") > 0, (F.abs("slope") >= F.abs(F.col("_own"))).cast("long"))
    return found.withColumn("_own", own).groupBy(*by).agg(
        F.first("_own").alias("observed"), F.count(null).alias("n_perm"), ((F.sum(hit) + 1) / (F.count(null) + 1)).alias("p_value"),
        F.avg(null).alias("null_mean"), F.percentile(null, 0.025).alias("null_lo"), F.percentile(null, 0.975).alias("null_hi"),
    )


#: All orders of more rows than this are refused: 10! is 3.6 million.
MOST_EXACT = 10


def _tested(dealt: DataFrame, by: list[str], kinds: dict[str, str], null: bool, slopes_of) -> DataFrame:
    """For units (by, v, start, ...) the orders' slopes: n, hits, observed and slope; a row for each order, or without ``null`` for each unit.

    ``slopes_of(row, u, v)`` gives the slopes of a unit's orders, for centred u.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                pairs = sorted((v["x"], v["y"]) for v in r.v)
                u, v = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
                u = u - u.mean()
                if not (u @ u) > 0:
                    continue
                found, own = slopes_of(r, u, v), float((v @ u) / (u @ u))
                hits = np.abs(found) >= abs(own) - 1e-12
                made = {"slope": found, "n": 1, "hits": hits.astype(np.int64)} if null else {"slope": [None], "n": [len(found)], "hits": [int(hits.sum())]}
                yield pd.DataFrame({**made, **{b: getattr(r, b) for b in by}, "observed": own})[[*by, "slope", "n", "hits", "observed"]].astype({"slope": float})

    found = dealt.mapInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", slope double, n long, hits long, observed double")
    ends = [F.percentile("slope", q).alias(c) for q, c in ((0.025, "null_lo"), (0.975, "null_hi"))] if null else []
    return found.groupBy(*by).agg(F.sum("n").alias("n_orders"), F.first("observed").alias("observed"), F.sum("hits").alias("hits"), *ends)


def _packed(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    pair = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.groupBy(*by).agg(F.collect_list(pair).alias("v"), F.count("*").alias("_n"))  # one row for each mainshock


def exact_permutation(rows: DataFrame, x: str, y: str, by: list[str], null: bool = True) -> DataFrame:
    """by, n_orders, observed slope and the exact two-sided p over all orders of y; with ``null`` its 2.5 and 97.5 % points.

    A group's orders are numbered and dealt to tasks in ranges; a number gives
    its order by the factorial number system.
    """
    packed = settle(_packed(rows.dropna(subset=[x, y]), x, y, by), "packed")
    largest = packed.agg(F.max("_n")).first()[0]
    if largest is not None and largest > MOST_EXACT:
        raise ValueError(f"{largest} rows have too many orders; use permutation_slopes")
    step = math.factorial(7)
    dealt = packed.withColumn("start", F.explode(F.expr(f"sequence(0L, factorial(cast(_n as int)) - 1, {step}L)"))).drop("_n").repartition(*by, "start")

    def slopes_of(r, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        numbers = np.arange(r.start, min(r.start + step, math.factorial(len(u))))
        return (v[orders_of(numbers, len(u))] @ u) / (u @ u)

    found = _tested(dealt, by, dict(rows.dtypes), null, slopes_of)
    return found.withColumn("p_value", F.col("hits") / F.col("n_orders")).drop("hits")


#: The prime 2^31 - 1 and multipliers of full period for it.
PRIME, MULTIPLIERS = 2_147_483_647, (48271, 69621, 39373)


def mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers below PRIME from whole numbers, by products and shifts that SQL has too."""
    a, b, c = MULTIPLIERS
    x = x % PRIME * a % PRIME
    x = (x ^ (x >> 15)) * b % PRIME
    return (x ^ (x >> 13)) * c % PRIME


def seeded_orders(reps: np.ndarray, n: int, seed: int) -> np.ndarray:
    """An order of n things for each repetition: by a hash of repetition, place and seed, then by place."""
    keys = mixed(mixed(reps.astype(np.int64) + seed)[:, None] + mixed(np.arange(1, n + 1, dtype=np.int64))[None, :])
    return np.argsort(keys, axis=1, kind="stable")


def order_permutation(rows: DataFrame, x: str, y: str, by: list[str], reps: int = 5000, seed: int = 7, null: bool = True) -> DataFrame:
    """exact_permutation for groups of up to MOST_EXACT rows; for larger ones ``reps`` seeded orders of all rows.

    n_orders is then reps and the p (hits + 1) / (reps + 1). Places are those
    by x and y, so orders depend on nothing but values, seed and repetition.
    """
    block = 500
    sized = settle(rows.dropna(subset=[x, y]).withColumn("_size", F.count("*").over(Window.partitionBy(*by))), "sized")
    packed = _packed(sized.where(F.col("_size") > MOST_EXACT), x, y, by).drop("_n")
    dealt = packed.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(block)))).repartition(*by, "start")

    def slopes_of(r, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        numbers = np.arange(r.start, min(r.start + block, reps))
        few = max(1, 4_000_000 // len(u))
        return np.concatenate([(v[seeded_orders(numbers[k : k + few], len(u), seed)] @ u) / (u @ u) for k in range(0, len(numbers), few)])

    drawn = _tested(dealt, by, dict(rows.dtypes), null, slopes_of)
    drawn = drawn.withColumn("p_value", (F.col("hits") + 1) / (F.col("n_orders") + 1)).drop("hits")
    return exact_permutation(sized.where(F.col("_size") <= MOST_EXACT), x, y, by, null).unionByName(drawn)


def orders_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """The orders of n things with the given numbers, each a row."""
    digits = np.empty((len(numbers), n), dtype=np.int64)
    rest = numbers.copy()
    for k in range(1, n + 1):
        digits[:, n - k] = rest % k
        rest //= k
    out = digits.copy()
    for i in range(n - 2, -1, -1):
        out[:, i + 1 :] += out[:, i + 1 :] >= out[:, i : i + 1]
    return out


def draw_matrix(records: DataFrame, draws: DataFrame, n: int, seed: int) -> DataFrame:
    """(record_id, rep, p): for each record n of its saved draws, picked by hash. A record without draws is an error."""
    without = records.select("record_id").join(draws.select("record_id"), "record_id", "left_anti").limit(5).collect()
    if without:
        raise ValueError(f"No bootstrap draws for {[r[0] for r in without]}")
    order = Window.partitionBy("record_id").orderBy("p_boot", "draw")
    numbered = draws.withColumns({"i": (F.row_number().over(order) - 1).cast("long")})
    sizes = draws.groupBy("record_id").agg(F.count("*").alias("m"))
    picks = repetitions(records.select("record_id").join(sizes, "record_id"), n).withColumn("i", draw_integer(F.lit(seed), F.col("record_id"), F.col("rep")) % F.col("m"))
    return picks.join(numbered.select("record_id", "i", "p_boot"), ["record_id", "i"]).select("record_id", "rep", F.col("p_boot").alias("p"))


