"""Subgroups of a sequence: rings, depth segments, half-planes, and events dealt to them."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.functions.geo import half_planes
from quakespark.functions.labels import depth_group, interval_label, record_id
from quakespark.operators.ordering import ranked_values
from quakespark.sources.tables import settle, small

Segment = tuple[float, float]


def merge_fewest(segments: list[Segment], counts: list[int]) -> list[Segment]:
    """The first of the fewest joined with its smaller neighbour, the left of equals."""
    i = counts.index(min(counts))
    left = i > 0 and (i == len(segments) - 1 or counts[i - 1] <= counts[i + 1])
    j = i - 1 if left else i
    return [*segments[:j], (segments[j][0], segments[j + 1][1]), *segments[j + 2 :]]


def merge_sparse(segments: list[Segment], count: Callable[[list[Segment]], list[int]], least: int, most: int | None = None) -> list[Segment]:
    """Neighbours merged until each has ``least`` or one is left, and then until there are ``most`` at most."""
    while len(segments) > 1 and (min(counts := count(segments)) < least or most is not None and len(segments) > most):
        segments = merge_fewest(segments, counts)
    return segments


def ring_counts(events: DataFrame, edges: list[float]) -> DataFrame:
    """Events by mainshock and ring ``[lo, hi)``: ring 0, 1, ... and n; farther events are in none."""
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    ring = F.size(F.filter(bounds, lambda e: e <= F.col("dist_km"))) - 1
    return events.where((F.col("dist_km") >= edges[0]) & (F.col("dist_km") < edges[-1])).groupBy("mainshock_id", ring.alias("ring")).agg(F.count("*").alias("n"))


def merged_rings(events: DataFrame, edges: list[float], least: int) -> DataFrame:
    """(mainshock_id, lo, hi): base rings merged where they have fewer than ``least`` events.

    Counting is Spark's; the merging sees a few counts for each mainshock.
    """
    edges = sorted({float(e) for e in edges})
    rings = list(zip(edges, edges[1:], strict=False))
    counts = ring_counts(events, edges)
    everyone = events.select("mainshock_id").distinct()

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        known = group.dropna(subset=["ring"])
        n = dict(zip(known["ring"].astype(int), known["n"].astype(int), strict=True))
        count = lambda segments: [sum(n.get(k, 0) for k, r in enumerate(rings) if lo <= r[0] and r[1] <= hi) for lo, hi in segments]
        return pd.DataFrame([(group["mainshock_id"].iloc[0], lo, hi) for lo, hi in merge_sparse(rings, count, least)], columns=["mainshock_id", "lo", "hi"])

    return everyone.join(counts, "mainshock_id", "left").groupBy("mainshock_id").applyInPandas(fold, "mainshock_id string, lo double, hi double")


class Depths:
    """Depths of a sequence as distinct values and their counts, or some of these with the numbers of rows below each.

    Some are enough where they hold what a rule asks for: the ends, the ranks
    about its quantiles, and the values next to its cuts.
    """

    def __init__(self, values: list[float], counts: list[int], before: list[int] | None = None):
        order = sorted(range(len(values)), key=values.__getitem__)
        self.values = [values[i] for i in order]
        if before is None:
            self.before = [0, *accumulate(counts[i] for i in order)][:-1]
        else:
            self.before = [before[i] for i in order]
        self.below = [b + counts[i] for b, i in zip(self.before, order, strict=True)]
        self.n = self.below[-1] if order else 0

    def at_most(self, x: float) -> int:
        i = bisect.bisect_right(self.values, x)
        return self.below[i - 1] if i else 0

    def less(self, x: float) -> int:
        i = bisect.bisect_left(self.values, x)
        if i < len(self.values) and self.values[i] == x:
            return self.before[i]
        return self.below[i - 1] if i else 0

    def quantile(self, q: float) -> float:
        """Linear between the two nearest ranks."""
        at = q * (self.n - 1)
        low = math.floor(at)
        a, b = self.ranked(low), self.ranked(min(low + 1, self.n - 1))
        return a + (at - low) * (b - a) if at - low < 0.5 else b - (b - a) * (1 - (at - low))

    def ranked(self, k: int) -> float:
        return self.values[bisect.bisect_right(self.below, k)]

    def counts(self, segments: list[Segment]) -> list[int]:
        """The first segment is ``[lo, hi]``, others ``(lo, hi]``, the last has no upper end."""
        ends = [0, *(self.n if math.isinf(hi) else self.at_most(hi) for _, hi in segments)]
        return [b - a for a, b in zip(ends, ends[1:], strict=False)]


def depth_segments_of(depths: Depths, least: int, target: int = 3, fewest: int = 2) -> list[Segment]:
    """Two or three depth segments of ``least`` events each, or none.

    Cuts at quantiles; where these coincide with each other or the minimum,
    the first cuts among the distinct depths (neither the first nor the last)
    that leave enough on every side. Sparse segments are merged.
    """
    d, n = depths, depths.n
    if n < fewest * least or not d.values:
        return []
    lowest = d.values[0]
    for k in range(target, 1, -1):
        cuts = sorted({c for c in (d.quantile(i / k) for i in range(1, k)) if c > lowest + 1e-9})
        if len(cuts) < k - 1:
            cuts, start = [], 0
            for u in d.values[1:-1]:
                if len(cuts) < k - 1 and u > lowest + 1e-9 and d.at_most(u) - start >= least:
                    cuts.append(u)
                    start = d.at_most(u)
            if len(cuts) < k - 1 or n - start < least:
                continue
        edges = [lowest, *cuts, math.inf]
        segments = merge_sparse(list(zip(edges, edges[1:], strict=False)), d.counts, least)
        segments = [s for s, c in zip(segments, d.counts(segments), strict=True) if c > 0]
        if len(segments) >= fewest and min(d.counts(segments)) >= least:
            return segments
    return []


def binned_depth_segments(depths: Depths, bins: list[float], least: int, most: int = 3) -> list[Segment]:
    """The other way to depth segments: fixed bins ``[lo, hi)`` and what lies below, merged to at most ``most``.

    Where one segment is left, thirds or halves by quantiles if each has
    ``least``; a single segment over all depths is none.
    """
    if not depths.values or len(bins) < 2:
        return []
    count = lambda segments: [depths.less(hi) - depths.less(lo) for lo, hi in segments]
    edges = [*map(float, bins), math.inf]
    merged = merge_sparse(list(zip(edges, edges[1:], strict=False)), count, least, most)
    merged = [s for s, n in zip(merged, count(merged), strict=True) if n]
    if len(merged) > 1:
        return merged
    for parts in range(min(3, most), 1, -1):
        cuts = [depths.values[0], *(depths.quantile(i / parts) for i in range(1, parts)), math.inf]
        split = list(zip(cuts, cuts[1:], strict=False))
        if depths.n >= parts * least and min(count(split)) >= least:
            return split
    return [s for s in merged if s[0] > edges[0] + 1e-9 or not math.isinf(s[1])]


def depth_marks(events: DataFrame, least: int, target: int, bins: list[float]) -> DataFrame:
    """(mainshock_id, marks): of each sequence the distinct depths that its segments can depend on, with n and below.

    All from one ranking of the depths and a few aggregations: the first and
    last, those at the ranks about every quantile, the deepest above each bin's
    edge, and one after another the first that has ``least`` events since the
    one before. So no task holds a sequence's depths.
    """
    values = ranked_values(events.where("depth_km IS NOT NULL").select("mainshock_id", F.col("depth_km").cast("double").alias("depth")), "depth", ["mainshock_id"])
    total = settle(values.groupBy("mainshock_id").agg(F.sum("n").alias("total"), F.min("depth").alias("lowest")), "totals")
    rows = values.join(small(total), "mainshock_id").withColumns({"end": F.col("below") + F.col("n"), "mark": F.struct("depth", "n", "below")})
    places = [f for k in range(2, target + 1) for i in range(1, k) for f in (F.floor(F.lit(i / k) * (F.col("total") - 1)), F.least(F.floor(F.lit(i / k) * (F.col("total") - 1)) + 1, F.col("total") - 1))]
    wanted = [F.min("mark"), F.max("mark"), *[F.max(F.when((F.col("below") <= p) & (p < F.col("end")), F.col("mark"))) for p in places], *[F.max(F.when(F.col("depth") < e, F.col("mark"))) for e in bins]]
    found = rows.groupBy("mainshock_id").agg(F.array(*wanted).alias("marks"))
    cuts, inner = None, (F.col("below") > 0) & (F.col("end") < F.col("total")) & (F.col("depth") > F.col("lowest") + 1e-9)
    for _ in range(target - 1):
        start = rows.withColumns({"_last": F.lit(-math.inf), "_end": F.lit(0)}) if cuts is None else rows.join(small(cuts), "mainshock_id")
        fits = inner & (F.col("depth") > F.col("_last")) & (F.col("end") - F.col("_end") >= least)
        cut = start.groupBy("mainshock_id").agg(F.min(F.when(fits, F.col("mark"))).alias("cut")).where("cut IS NOT NULL")
        cuts = settle(cut.select("mainshock_id", F.col("cut.depth").alias("_last"), (F.col("cut.below") + F.col("cut.n")).alias("_end"), "cut"), "cuts")
        found = found.join(small(cuts.select("mainshock_id", F.array("cut").alias("_cut"))), "mainshock_id", "left").select("mainshock_id", F.concat("marks", F.coalesce("_cut", F.array().cast(cuts.select(F.array("cut")).schema[0].dataType))).alias("marks"))
        cuts = cuts.drop("cut")
    return found.select("mainshock_id", F.array_distinct(F.filter("marks", lambda m: m.isNotNull())).alias("marks"))


def depth_segments(events: DataFrame, least: int, target: int = 3, fewest: int = 2, bins: list[float] | None = None) -> DataFrame:
    """(mainshock_id, lo, hi, first): depth segments of each sequence that can be split; hi is infinity in the last.

    The rules see a few depths of each sequence (see ``depth_marks``).
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, marks in zip(batch["mainshock_id"], batch["marks"], strict=True):
                depths = Depths([m["depth"] for m in marks], [int(m["n"]) for m in marks], [int(m["below"]) for m in marks])
                found = depth_segments_of(depths, least, target, fewest) if bins is None else binned_depth_segments(depths, bins, least, target)
                out += [(name, lo, hi, k == 0) for k, (lo, hi) in enumerate(found)]
            yield pd.DataFrame(out, columns=["mainshock_id", "lo", "hi", "first"]).astype({"lo": float, "hi": float, "first": bool})

    marks = depth_marks(events, least, max(target, 3), [] if bins is None else [float(e) for e in bins])
    return marks.mapInPandas(fold, "mainshock_id string, lo double, hi double, first boolean")


def expand(events: DataFrame, rings: DataFrame | None = None, depths: DataFrame | None = None, regions: dict[str, Column] | None = None, carry: tuple[str, ...] = ("t_days",)) -> DataFrame:
    """Thin rows (mainshock_id, subgroup_type, subgroup, record_id, *carry): each event once for each subgroup it is in.

    Every event is in ``all_depth``; half-planes around the mainshock unless
    ``regions`` names other predicates; rings and depth segments as given.
    """
    thin = lambda f, kind, name: f.select("mainshock_id", F.lit(kind).alias("subgroup_type"), name.alias("subgroup"), *carry)
    places = half_planes(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) if regions is None else F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in regions.items()]), lambda x: x.isNotNull())
    label = interval_label(F.col("lo"), F.col("hi"))  # written once for a segment, not for each event
    out = thin(events, "depth", F.lit("all_depth")).unionByName(thin(events.withColumn("_place", F.explode(places)), "region", F.col("_place")))
    if rings is not None:
        met = events.join(small(settle(rings.withColumn("_label", label), "rings")), "mainshock_id").where((F.col("dist_km") >= F.col("lo")) & (F.col("dist_km") < F.col("hi")))
        out = out.unionByName(thin(met, "ring", F.col("_label")))
    if depths is not None:
        met = events.join(small(settle(depths.withColumn("_label", label), "depths")), "mainshock_id").where((F.col("depth_km") > F.col("lo")) & (F.col("depth_km") <= F.col("hi")) | F.col("first") & (F.col("depth_km") == F.col("lo")))
        out = out.unionByName(thin(met, "depth", F.col("_label")))
    return out.withColumn("record_id", record_id(F.col("mainshock_id"), F.col("subgroup_type"), F.col("subgroup")))


#: What tells apart the cells of ``placed``.
CELL = ["mainshock_id", "_ring", "_ew", "_ns", "_depth"]


def placed(events: DataFrame, rings: DataFrame, bins: list[float]) -> DataFrame:
    """Events with their cell (CELL): ring (null in none), half-planes and fixed depth group. Each event once."""
    named = rings.select(F.col("mainshock_id").alias("_m"), "lo", "hi", interval_label(F.col("lo"), F.col("hi")).alias("_ring"))
    inside = (F.col("mainshock_id") == F.col("_m")) & (F.col("dist_km") >= F.col("lo")) & (F.col("dist_km") < F.col("hi"))
    places = half_planes(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    return events.join(small(settle(named, "rings")), inside, "left").withColumns({"_ew": places[0], "_ns": places[1], "_depth": depth_group(F.col("depth_km"), bins)}).drop("_m", "lo", "hi")


def of_cells(cells: DataFrame) -> DataFrame:
    """Rows of cells (CELL, others) once for each subgroup that the cell is in: all depths, its half-planes, ring and depth group."""
    kinds = (("depth", F.lit("all_depth")), ("region", F.col("_ew")), ("region", F.col("_ns")), ("ring", F.col("_ring")), ("depth", F.col("_depth")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("subgroup_type"), name.alias("subgroup")) for k, name in kinds])).alias("_s")
    others = [c for c in cells.columns if c not in CELL]
    dealt = cells.select("mainshock_id", *others, each).select("mainshock_id", "_s.*", *others).where("subgroup IS NOT NULL")
    return dealt.withColumn("record_id", record_id(F.col("mainshock_id"), F.col("subgroup_type"), F.col("subgroup")))
