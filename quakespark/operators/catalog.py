"""Mainshocks, their aftershocks, and the cleaned catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.geo import EVENT_RADIUS_KM, cell, cell_ranges, cells_around, circle_bounds, haversine_km
from quakespark.operators.ordering import following
from quakespark.sources.tables import BROADCAST_ROWS, settle, small

DAY_US = 86_400_000_000
#: Side of the grid cells by which points meet the circles around them.
CELL_DEGREES = 2.0
#: Points of a cell in a bucket of time before it is quartered, and how often that may be done.
CELL_ROWS, LEVELS = 50_000, 6


def search(catalog: DataFrame, lat: tuple[float, float], lon: tuple[float, float], start=None, end=None, min_mag: float | None = None) -> DataFrame:
    """Events in a box, between two times and from a magnitude on; all ends belong to it."""
    found = catalog.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    if start is not None:
        found = found.where(F.col("time_utc") >= F.lit(start).cast("timestamp"))
    if end is not None:
        found = found.where(F.col("time_utc") <= F.lit(end).cast("timestamp"))
    return found if min_mag is None else found.where(F.col("mag") >= min_mag)


def strongest(catalog: DataFrame, area: list[str] | None = None) -> DataFrame:
    """The event of the greatest magnitude, the earliest of equals; of each area if columns are given."""
    order = [F.col("mag").desc_nulls_last(), "time_us", "usgs_id"]
    if not area:
        return catalog.orderBy(*order).limit(1)
    first = F.min_by(F.struct(*[c for c in catalog.columns if c not in area]), F.struct((-F.col("mag")).alias("m"), "time_us", "usgs_id"))
    return catalog.where("mag is not null").groupBy(*area).agg(first.alias("e")).select(*area, "e.*")


#: Far above the logarithm of any catalog's length.
MOST_ROUNDS = 60


def decluster(candidates: DataFrame, window_days: float, most: int | None = None, region: str | None = None) -> DataFrame:
    """In order of time, the events at least ``window_days`` after the last one kept, up to ``most``; by region if given.

    Every time points to the first one a window or more later; kept is what
    the pointers reach from the times that have none less than a window before
    them, which are kept in any case. Pointers are doubled: after k rounds of
    joins each spans 2^k steps, so a dense catalog takes as many rounds as the
    logarithm of the events kept, in as many tasks as any join. Of equal times
    the first identifier is kept; events without a time are left out.
    """
    window = max(1, int(window_days * DAY_US))
    key = F.lit("") if region is None else F.coalesce(F.col(region).cast("string"), F.lit(""))
    keyed = candidates.where("time_us IS NOT NULL").withColumn("_region", key)
    times = settle(keyed.select("_region", F.col("time_us").alias("t")).distinct(), "times")
    asks = F.explode(F.array(*[F.struct((F.col("t") + d).alias("at"), F.lit(k).alias("kind")) for k, d in ((0, 1 - window), (1, window), (2, 0))])).alias("a")
    rows = times.select("_region", "t", asks).select("_region", "t", "a.*").withColumns({"stands": (F.col("kind") == 2).cast("int"), "own": F.when(F.col("kind") == 2, F.col("t"))})
    found = settle(following(rows, ["_region"], ["at", "stands"], "own", "next").where("kind < 2"), "pointers")
    marks = settle(found.where("kind = 0 AND next = t").select("_region", "t"), "marks")
    jumps = found.where("kind = 1 AND next IS NOT NULL").select("_region", "t", "next")
    n = marks.count()
    # joins of settled tables: Spark broadcasts a side by its files' size
    for _ in range(MOST_ROUNDS):
        reached = jumps.join(marks, ["_region", "t"]).select("_region", F.col("next").alias("t"))
        marks = settle(marks.unionByName(reached).distinct(), "marks")
        before, n = n, marks.count()
        if n == before:
            break
        onward = jumps.select("_region", F.col("t").alias("next"), F.col("next").alias("_onward"))
        jumps = settle(jumps.join(onward, ["_region", "next"]).select("_region", "t", F.col("_onward").alias("next")), "jumps")
    kept = keyed.join(marks.withColumnRenamed("t", "time_us"), ["_region", "time_us"], "left_semi")
    first = F.min_by(F.struct(*candidates.columns), F.struct(F.col("usgs_id").isNotNull(), "usgs_id"))
    found = kept.groupBy("_region", "time_us").agg(first.alias("e")).select("_region", "e.*")
    if most is not None:
        order = Window.partitionBy("_region").orderBy("time_us", "usgs_id")  # one event for each window of time at most
        found = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    return found.select(*candidates.columns)


def near_pairs(points: DataFrame, centers: DataFrame, radius_km: float, earth_km: float = EVENT_RADIUS_KM, degrees: float = CELL_DEGREES, span_us: int | None = None, broadcast_rows: int = BROADCAST_ROWS, bound: int = CELL_ROWS) -> DataFrame:
    """Points and the centers (c_lat, c_lon) within a distance of them, with dist_km.

    Both meet on a cell of the sphere: a center is repeated for the cells that
    its circle may touch, a point has one. With ``span_us`` they also meet on
    a bucket of time of that length: a center (ms_time_us) has the buckets up
    to ``span_us`` later, and points (time_us) farther off are left out.
    Centers are broadcast where they have few cells. Else it is a shuffled join
    on cell and bucket, and cells of more than ``bound`` points in a bucket
    are quartered, as often as it takes (see ``adapted``).
    """
    on = {"_t": F.lit(0).cast("long")}
    spread = centers.withColumn("_t", F.lit(0).cast("long"))
    if span_us is not None:
        bucket = lambda time: F.floor(time / span_us)
        on["_t"] = bucket(F.col("time_us"))
        spread = centers.withColumn("_t", F.explode(F.sequence(bucket(F.col("ms_time_us")), bucket(F.col("ms_time_us") + span_us))))
    y, x = cell(F.col("lat"), F.col("lon"), degrees)
    cells = spread.withColumn("_cell", F.explode(cells_around(F.col("c_lat"), F.col("c_lon"), radius_km, degrees))).withColumns({"_y": F.col("_cell.y"), "_x": F.col("_cell.x")}).drop("_cell")
    keys = ["_y", "_x", "_t"]
    if cells.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = points.withColumns(on | {"_y": y, "_x": x}).join(F.broadcast(cells), keys)
    else:
        keys = [*keys, "_level", "_salt"]
        own, circles = adapted(points.withColumns(on), cells, radius_km, degrees, bound)
        met = own.join(circles, keys)
    if span_us is not None:
        met = met.where((F.col("time_us") >= F.col("ms_time_us")) & (F.col("time_us") <= F.col("ms_time_us") + span_us))
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"), earth_km)
    return met.withColumn("dist_km", far).where(F.col("dist_km") <= radius_km).drop(*keys)


def adapted(points: DataFrame, cells: DataFrame, radius_km: float, degrees: float, bound: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Points (lat, lon, _t) with their leaf (_level, _y, _x) and _salt, and circles (c_lat, c_lon, _t, _y, _x) with all leaves that they may touch.

    Cells are counted by bucket on the finest grid. A cell that has more than
    ``bound`` points in a bucket is quartered, down to LEVELS times; leaves
    that still have more are dealt over salts, which their circles repeat. So
    no key has many more than ``bound`` points, and what a circle is repeated
    for grows with the points about it only.
    """
    finest = degrees / (1 << LEVELS)
    up = lambda c, level: F.shiftright(F.col(c), LEVELS - level)
    fy, fx = cell(F.col("lat"), F.col("lon"), finest)
    placed = points.withColumns({"_fy": fy, "_fx": fx})
    counts = settle(placed.groupBy("_fy", "_fx", "_t").agg(F.count("*").alias("n")), "histogram")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), up("_fy", k).alias("_y"), up("_fx", k).alias("_x")) for k in range(LEVELS + 1)])).alias("c")
    crowded = counts.select("_t", "n", levels).select("_t", "n", "c.*").groupBy("_level", "_y", "_x", "_t").agg(F.sum("n").alias("n")).groupBy("_level", "_y", "_x").agg(F.max("n").alias("n")).where(F.col("n") > bound)
    crowded = settle(crowded.select("_level", "_y", "_x", F.ceil(F.col("n") / bound).cast("int").alias("_salts")), "crowded")  # a few for each ``bound`` points
    split = lambda k: small(crowded.where(F.col("_level") == k).select(F.col("_y").alias(f"_y{k}"), F.col("_x").alias(f"_x{k}"), F.col("_salts").alias(f"_s{k}")))
    own = placed
    for k in range(LEVELS + 1):
        own = own.withColumns({f"_y{k}": up("_fy", k), f"_x{k}": up("_fx", k)}).join(split(k), [f"_y{k}", f"_x{k}"], "left")
    level = F.coalesce(*[F.when(F.col(f"_s{k}").isNull(), F.lit(k)) for k in range(LEVELS)], F.lit(LEVELS))
    salt = F.when((F.col("_level") == LEVELS) & F.col(f"_s{LEVELS}").isNotNull(), F.pmod(F.xxhash64("lat", "lon", F.monotonically_increasing_id()), F.col(f"_s{LEVELS}"))).otherwise(0).cast("int")
    own = own.withColumn("_level", level).withColumns({"_y": F.expr(f"shiftright(_fy, {LEVELS} - _level)"), "_x": F.expr(f"shiftright(_fx, {LEVELS} - _level)"), "_salt": salt})
    own = own.drop("_fy", "_fx", *[f"_{c}{k}" for k in range(LEVELS + 1) for c in "yxs"])
    leaves, open_ = None, cells
    for k in range(LEVELS + 1):
        flagged = open_.join(split(k).withColumnsRenamed({f"_y{k}": "_y", f"_x{k}": "_x", f"_s{k}": "_salts"}), ["_y", "_x"], "left")
        done = flagged.where("_salts IS NULL").withColumn("_salt", F.lit(0)) if k < LEVELS else flagged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        done = done.withColumn("_level", F.lit(k)).drop("_salts")
        leaves = done if leaves is None else leaves.unionByName(done)
        if k == LEVELS:
            break
        below = degrees / (2 << k)
        low, high, first, last = cell_ranges(F.col("c_lat"), F.col("c_lon"), radius_km, below)
        child = F.explode(F.array(*[F.struct((2 * F.col("_y") + i).alias("y"), (2 * F.col("_x") + j).alias("x")) for i in (0, 1) for j in (0, 1)])).alias("_child")
        quarters = flagged.where("_salts IS NOT NULL").drop("_salts").select("*", child)
        touched = F.col("_child.y").between(low, high) & (F.pmod(F.col("_child.x") - first, F.lit(round(360 / below))) <= last - first)
        open_ = quarters.where(touched).withColumns({"_y": F.col("_child.y"), "_x": F.col("_child.x")}).drop("_child")
    return own, leaves


def mainshock_columns(mainshocks: DataFrame) -> DataFrame:
    return mainshocks.select(F.col("usgs_id").alias("mainshock_id"), F.col("time_us").alias("ms_time_us"), F.col("mag").alias("mainshock_mag"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))


def aftershocks(catalog: DataFrame, mainshocks: DataFrame, radius_km: float, days: float, min_mag: float) -> DataFrame:
    """Events within the radius of a mainshock, after it and up to ``days`` later, from a magnitude on.

    One row for each mainshock and event; t_days counts from the mainshock.
    """
    slim = catalog.where(F.col("mag") >= min_mag).select("usgs_id", "time_us", "lat", "lon", "depth_km", "mag")
    pairs = near_pairs(slim, mainshock_columns(mainshocks), radius_km, span_us=int(days * DAY_US))
    after = pairs.where((F.col("time_us") > F.col("ms_time_us")) & (F.col("usgs_id") != F.col("mainshock_id")))
    return after.withColumn("t_days", (F.col("time_us") - F.col("ms_time_us")) / float(DAY_US))


def clean_run(features: DataFrame, mainshocks: DataFrame, sanity: bool) -> DataFrame:
    """Downloaded features of runs (``run`` is the mainshock's id) as a catalog: after the mainshock, without it.

    ``sanity`` also wants magnitudes in [-1, 10] and depths in [-5, 800] or null.
    """
    joined = features.join(small(mainshock_columns(mainshocks)), F.col("run") == F.col("mainshock_id")).drop("run")
    kept = joined.where(~F.col("usgs_id").eqNullSafe(F.col("mainshock_id")) & (F.col("time_us") > F.col("ms_time_us"))).withColumn("t_days", (F.col("time_us") - F.col("ms_time_us")) / float(DAY_US))
    if sanity:
        kept = kept.where(F.col("mag").between(-1, 10) & (F.col("depth_km").isNull() | F.col("depth_km").between(-5, 800)))
    return kept


def summary(catalog: DataFrame, by: list[str]) -> DataFrame:
    ends = [f(c).alias(f"{n}_{c}") for c in ("mag", "depth_km", "t_days") for n, f in (("min", F.min), ("max", F.max))]
    return catalog.groupBy(*by).agg(F.count("*").alias("n_rows"), *ends)


def run_index(mainshocks: DataFrame, catalog: DataFrame, **parameters) -> DataFrame:
    """Each mainshock's row with its number of events (0 for none) and the job's parameters."""
    counts = catalog.groupBy(F.col("mainshock_id").alias("usgs_id")).agg(F.count("*").alias("_n"))
    named = mainshocks.select("usgs_id", "time_us", "mag", "lat", "lon", "depth_km", "place").join(counts, "usgs_id", "left")
    return named.withColumn("aftershocks_n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n").withColumns({k: F.lit(v) for k, v in parameters.items()})


def boxes(mainshocks: DataFrame, radius_km: float) -> DataFrame:
    m = mainshock_columns(mainshocks)
    return m.select("mainshock_id", *[v.alias(k) for k, v in circle_bounds(F.col("c_lat"), F.col("c_lon"), radius_km).items()])

