"""Omori-Utsu decay K / (t + c)^p: likelihood, fits, bootstrap and rates.

For given c and p the best K is n / I(c, p), so a fit needs only n and the sum
of ln(t + c). That sum is an analytic function of u = ln c, with no singularity
nearer than pi to the real line: its values at NODES Chebyshev points give it
everywhere in the range of c. They are an ordinary aggregation, combined before
they are shuffled: the times are read once, and a fit is then worked out from
its row of sums. So a record's times never meet in one task, whatever their
number, and every record is fitted alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.functions.digests import md5_leading
from quakespark.sources.tables import settle, small, together

C_RANGE, P_RANGE = (1e-6, 10.0), (0.2, 5.0)
C_STEPS, P_STEPS = 40, 60
#: Fewer events in the window than this give no fit.
LEAST = 20
#: Points at which sums are taken: the error of the interpolation is some 1.46^-NODES of a sum.
NODES = 80
#: A fit looks at C_STEPS values of c, then at so many steps between the neighbours of the best, some rounds.
ROUNDS, STEPS = 5, 16
#: A bootstrap draw is fitted at so many c, up to REACH away from the record's own in ln c.
DRAW_STEPS, REACH = 25, 4.0
#: Times of a record that are weighed together for its draws: some seconds of work at 200 draws.
PER_TASK = 100_000
#: And no more tasks than this in all.
MOST_TASKS = 4096
#: Times weighed at once for all draws: their arrays stay in a core's cache.
BLOCK = 256
#: As BLOCK where weights are digests: these are worked out by the length of an event's name, so that few would be worked on at once.
DIGEST_BLOCK = 4096
#: A task passes its sums on when it has those of so many groups.
MOST_GROUPS = 4096


def c_grid(n: int = C_STEPS) -> list[float]:
    low, high = math.log(C_RANGE[0]), math.log(C_RANGE[1])
    return [math.exp(low + (high - low) * i / (n - 1)) for i in range(n)]


def p_grid(n: int = P_STEPS) -> list[float]:
    return [P_RANGE[0] + (P_RANGE[1] - P_RANGE[0]) * i / (n - 1) for i in range(n)]


def integral(c: Column, p: Column, low: Column, high: Column) -> Column:
    """The integral of (t + c)^-p from low to high."""
    near = F.abs(p - 1) <= 1e-6
    return F.when(near, F.log((high + c) / (low + c))).otherwise((F.pow(high + c, 1 - p) - F.pow(low + c, 1 - p)) / F.when(near, None).otherwise(1 - p))


def negative_log_likelihood(times: DataFrame, by: list[str], k: float, c: float, p: float, low: float, high: float) -> DataFrame:
    """n and the negative log-likelihood of given parameters over the times in [low, high], by group."""
    k_, c_, p_ = F.lit(float(k)), F.lit(float(c)), F.lit(float(p))
    nll = k_ * integral(c_, p_, F.lit(float(low)), F.lit(float(high))) - (F.count("*") * F.log(k_) - p_ * F.sum(F.log(F.col("t_days") + c_)))
    return times.where(F.col("t_days").between(low, high)).groupBy(*by).agg(F.count("*").alias("n_events"), nll.alias("nll"))


def log_sums(times: DataFrame, by: list[str], cs: list[float], low: float | Column, high: float, least: int, raw: int, weight: Column | None = None) -> DataFrame:
    """(by, n_events, sums): the times in [low, high] of each group, with their weight, and the sums of ln(t + c) for each c.

    Of groups that have ``raw`` times in all and ``least`` in the window.
    """
    return gated(log_parts(times, by, cs, low, high, weight), by, len(cs), least, raw)


def gated(parts: DataFrame, by: list[str], n: int, least: int, raw: int) -> DataFrame:
    """(by, n_events, sums) of ``log_parts`` for n values of c, added up by group; of groups as in ``log_sums``."""
    whole = together(parts, by, {"sums": n}, also="_all")
    return whole.where((F.col("_all") >= raw) & (F.col("n") >= least)).select(*by, F.col("n").cast("long").alias("n_events"), "sums")


def log_parts(times: DataFrame, by: list[str], cs: list[float], low: float | Column, high: float, weight: Column | None = None) -> DataFrame:
    """(by, _all, n, sums) in parts to be added up: all times of a group, those in [low, high], and their sums of ln(t + c).

    The times are read once: each task adds up its own by numpy, as so many
    columns of an aggregation are more than the JVM compiles, and only the
    sums of its groups are shuffled.
    """
    w = (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("double")
    inside = F.coalesce(F.col("t_days").between(low, high), F.lit(False))
    rows = times.select(*by, F.when(inside, F.col("t_days").cast("double")).otherwise(1.0).alias("_t"), F.when(inside, w).otherwise(0.0).alias("_w"), w.alias("_raw"))
    c = np.array(cs, dtype=float)

    def table(found: dict[tuple, np.ndarray], kinds: list[pa.DataType]) -> pa.RecordBatch:
        own = [pa.array([k[i] for k in found], type=kind) for i, kind in enumerate(kinds)]
        total = np.stack(list(found.values()))
        sums = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * len(c), total[:, 2:].ravel())
        return pa.RecordBatch.from_arrays([*own, pa.array(total[:, 0]), pa.array(total[:, 1]), sums], [*by, "_all", "n", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kinds = {}, []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(b).type for b in by]
            codes, size = np.zeros(batch.num_rows, dtype=np.int64), 1
            for b in by:
                own = batch.column(b).dictionary_encode("encode")
                if size * len(own.dictionary) >= 2**62:
                    codes, size = np.unique(codes, return_inverse=True)[1], batch.num_rows
                codes, size = codes * len(own.dictionary) + own.indices.to_numpy(), size * len(own.dictionary)
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            t, w, every = (batch.column(x).to_numpy()[order] for x in ("_t", "_w", "_raw"))
            for at in range(0, len(t), BLOCK):
                part = slice(at, at + BLOCK)
                starts = np.flatnonzero(np.r_[True, codes[part][1:] != codes[part][:-1]])
                weighed = np.column_stack([every[part], w[part], np.log(t[part, None] + c) * w[part, None]])
                for first, total in zip(order[part][starts], np.add.reduceat(weighed, starts), strict=True):
                    key = tuple(batch.column(b)[int(first)].as_py() for b in by)
                    if key in found:
                        found[key] += total
                    else:
                        found[key] = total.copy()
            if len(found) >= MOST_GROUPS:
                yield table(found, kinds)
                found = {}
        if found:
            yield table(found, kinds)

    names = dict(times.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{b}` {names[b]}" for b in by], "_all double, n double, sums array<double>"]))


def grid_fit(times: DataFrame, by: list[str], low: float, high: float, least: int = LEAST, raw: int = 0, weight: Column | None = None) -> DataFrame:
    """The best of C_STEPS x P_STEPS grid points by group: n_events, k, c, p, nll. One aggregation, no skew.

    A group needs ``raw`` times in all and ``least`` in the window. ``weight``
    (a whole number) says how often a time counts.
    """
    return best_of_grid(log_sums(times, by, c_grid(), low, high, least, raw, weight), by, low, high)


def best_of_grid(sums: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """``grid_fit`` from the sums of ``log_sums`` at the values of c_grid."""
    logs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.col("sums")[i].alias("logs")) for i, c in enumerate(c_grid())])
    ps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(p).alias("p")) for j, p in enumerate(p_grid())])
    tried = sums.select(*by, "n_events", F.explode(logs).alias("g")).select(*by, "n_events", "g.*", F.explode(ps).alias("q")).select(*by, "n_events", "i", "c", "logs", "q.*")
    k = F.col("n_events") / integral(F.col("c"), F.col("p"), F.lit(float(low)), F.lit(float(high)))
    tried = tried.withColumn("k", k).withColumn("nll", F.col("n_events") - F.col("n_events") * F.log("k") + F.col("p") * F.col("logs"))
    best = F.min_by(F.struct("n_events", "k", "c", "p", "nll"), F.struct(F.round("nll", 9).alias("nll"), "i", "j"))
    return tried.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


# ---- refinement: numpy, over the sums of many records at a time


def _integral(c, p, low: float, high: float):
    a, b = np.log(low + c), np.log(high + c)
    q = 1.0 - p
    small_q = np.abs(q) <= 1e-12
    safe = np.where(small_q, 1.0, q)
    return np.exp(a * q) * np.where(small_q, b - a, np.expm1((b - a) * q) / safe)


def profile(c, p, n, logs, low: float, high: float):
    """Negative log-likelihood with the best K, from n and the sums of ln(t + c)."""
    return n - n * np.log(n / _integral(c, p, low, high)) + p * logs


def best_p(c: np.ndarray, n: np.ndarray, logs: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(nll, p) for arrays of one shape: the likelihood is convex in p, so golden sections close in on the best."""
    f = lambda p: profile(c, p, n, logs, low, high)
    a, b = (np.full(np.shape(logs), end) for end in P_RANGE)
    ratio = (math.sqrt(5) - 1) / 2
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(40):
        lower = fx <= fy
        a, b = np.where(lower, a, x), np.where(lower, y, b)
        new = np.where(lower, b - ratio * (b - a), a + ratio * (b - a))
        value = f(new)
        x, y, fx, fy = np.where(lower, new, y), np.where(lower, x, new), np.where(lower, value, fy), np.where(lower, fx, value)
    found = [(f(p), p) for p in ((a + b) / 2, np.full(np.shape(logs), P_RANGE[0]), np.full(np.shape(logs), P_RANGE[1]))]
    nll, p = found[0]
    for value, end in found[1:]:
        nll, p = np.where(value < nll, value, nll), np.where(value < nll, end, p)
    return nll, p


def nodes() -> np.ndarray:
    """The Chebyshev points of the range of ln c."""
    low, high = math.log(C_RANGE[0]), math.log(C_RANGE[1])
    return (low + high) / 2 + (high - low) / 2 * np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)


def interpolated(sums: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row the sum of ln(t + e^u) at its row of u, from its sums at the nodes."""
    k = np.arange(NODES)
    waves = np.cos(np.pi * k[:, None] * (k[None, :] + 0.5) / NODES) * 2 / NODES
    waves[0] /= 2
    low, high = math.log(C_RANGE[0]), math.log(C_RANGE[1])
    angle = np.arccos(np.clip((2 * u - low - high) / (high - low), -1, 1))
    return np.einsum("rk,ruk->ru", sums @ waves.T, np.cos(angle[:, :, None] * k))


FITS = "n_events long, k double, c double, p double, nll double"


def _solver(by: list[str], kinds: dict[str, str], low: float | str, high: float):
    """For rows of sums at the nodes the best c and p (FITS); and the schema of that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = math.log(C_RANGE[0]), math.log(C_RANGE[1])
        for batch in batches:
            for at in range(0, len(batch), 256):
                own = batch.iloc[at : at + 256]
                n, sums = own["n_events"].to_numpy(float), np.stack(own["sums"].to_numpy())
                start = own[low].to_numpy(float)[:, None] if isinstance(low, str) else low
                u, rows = np.tile(np.log(c_grid()), (len(own), 1)), np.arange(len(own))
                for left in range(ROUNDS, -1, -1):
                    nll, p = best_p(np.exp(u), n[:, None], interpolated(sums, u), start, high)
                    best = np.argmin(nll, axis=1)
                    if left:
                        sides = u[rows, np.maximum(best - 1, 0)], u[rows, np.minimum(best + 1, u.shape[1] - 1)]
                        u = np.clip(np.linspace(*sides, STEPS + 1, axis=1), *ends)
                c, p = np.exp(u[rows, best]), p[rows, best]
                first = start[:, 0] if isinstance(low, str) else low
                yield own[by].assign(n_events=own["n_events"], k=n / _integral(c, p, first, high), c=c, p=p, nll=nll[rows, best])

    return run, ", ".join([*[f"{b} {kinds[b]}" for b in by], FITS])


def fit(times: DataFrame, by: list[str], low: float | str, high: float | None, least: int = LEAST, raw: int = 0) -> DataFrame:
    """Fits by group over [low, high] (null: to the latest time of all): by, n_events, k, c, p, nll.

    ``low`` may name one of the columns ``by``. A group needs ``raw`` times in
    all and ``least`` in the window. One aggregation over the times.
    """
    end = float(times.agg(F.max("t_days")).first()[0] or 0.0) if high is None else float(high)
    sums = log_sums(times, by, np.exp(nodes()).tolist(), F.col(low) if isinstance(low, str) else low, end, least, raw)
    run, schema = _solver(by, dict(times.dtypes), low, end)
    return settle(sums.mapInPandas(run, schema), "fits")


def sensitivity(events: DataFrame, mcs: list[float], starts: list[float], high: float, least: int = 200) -> DataFrame:
    """Fits of all events for each completeness magnitude and start time: mc, tmin_days, n_events, k, c, p, nll.

    An event is counted once, in the cell of the greatest magnitude and start
    that it reaches; a fit's sums are those of the cells at or above its own.
    """
    mcs, starts = sorted({float(m) for m in mcs}), sorted({float(s) for s in starts})
    reached = lambda c, values: F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.col(c) >= v))
    inside = (F.col("s") > 0) & (F.col("t_days") <= float(high))
    logs = F.array(*[F.coalesce(F.sum(F.when(inside, F.log(F.col("t_days") + float(c)))), F.lit(0.0)) for c in np.exp(nodes())])
    cells = events.select("t_days", reached("mag", mcs).alias("m"), reached("t_days", starts).alias("s")).where("m > 0")
    cells = cells.groupBy("m", "s").agg(F.count("*").alias("raw"), F.count(F.when(inside, 1)).alias("n"), logs.alias("sums"))
    fits = F.array(*[F.when(F.col("m") > i, F.struct(F.lit(m).alias("mc"), F.lit(s).alias("tmin_days"), (F.col("s") > j).cast("double").alias("w"))) for i, m in enumerate(mcs) for j, s in enumerate(starts)])
    parts = settle(cells, "cells").withColumn("f", F.explode(F.filter(fits, lambda f: f.isNotNull()))).select("raw", "n", "sums", "f.*")
    sums = F.array(*[F.sum(F.col("w") * F.col("sums")[k]) for k in range(NODES)])
    whole = parts.groupBy("mc", "tmin_days").agg(F.sum("raw").alias("raw"), F.sum(F.col("w") * F.col("n")).cast("long").alias("n_events"), sums.alias("sums")).where((F.col("raw") >= least) & (F.col("n_events") >= LEAST))
    run, schema = _solver(["mc", "tmin_days"], {"mc": "double", "tmin_days": "double"}, "tmin_days", float(high))
    return settle(whole.drop("raw").mapInPandas(run, schema), "fits")


def _poisson_ends(n: int) -> list[float]:
    """Shares of a Poisson number of mean one that are at most 0, 1, ..."""
    total, term, ends = 0.0, math.exp(-1), []
    for k in range(n):
        total += term
        term /= k + 1
        ends.append(total)
    return ends


def _reached(values: np.ndarray, ends) -> np.ndarray:
    """For each value how many of a few ends it reaches."""
    out = np.zeros(values.shape, dtype=np.int8)
    for row, own in zip(out, values, strict=True):  # which stay in a core's cache
        for end in ends:
            row += own >= end
    return out.astype(float)


def _uniform(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers of (key, draw, seed), a row for each key: integer mixing, so they depend on nothing else."""
    start = np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))
    x = keys[:, None] ^ ((draws[None, :].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + start)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def _draw_sums(keyed: DataFrame, records: DataFrame, key: str, numbers: np.ndarray, weights, steps, block: int = BLOCK) -> DataFrame:
    """(record_id, draw, u0, n, logs): for each draw the weights of a record's times and their sums of ln(t + c), in parts to be added up.

    ``records``: record_id, u0, n_events. ``weights(record_id, rows)`` gives the
    draws' weights, (draws, rows), for ``block`` rows at most; ``steps(u0)`` the values of c. There are
    tasks by the number of times, set here as the work is that of ``numbers``
    times the rows, which the size of a shuffle does not tell.
    """
    points = settle(records.select("record_id", "u0", F.col("n_events").alias("_n"), F.ceil(F.col("n_events") / PER_TASK).alias("tasks")), "points")
    events = points.agg(F.sum("_n")).first()[0] or 0
    tasks = min(MOST_TASKS, 1 + int(3 * events // PER_TASK))
    salt = F.pmod(F.xxhash64(key), F.col("tasks"))
    dealt = keyed.join(small(points.drop("_n")), "record_id").repartition(tasks, "record_id", salt).sortWithinPartitions("record_id")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, u0 = None, None, 0.0

        def done() -> pd.DataFrame:
            return pd.DataFrame({"record_id": now, "draw": numbers, "u0": u0, "n": total[:, 0], "logs": list(total[:, 1:])})

        for batch in batches:
            for record, own in batch.groupby("record_id", sort=False):
                if record != now:
                    if now is not None:
                        yield done()
                    now, u0 = record, float(own["u0"].iloc[0])
                    c = steps(u0)
                    total = np.zeros((len(numbers), len(c) + 1))
                for at in range(0, len(own), block):
                    part = own.iloc[at : at + block]
                    t = part["t_days"].to_numpy()
                    total += weights(record, part) @ np.column_stack([np.ones(len(t)), np.log(t[:, None] + c[None, :])])
        if now is not None:
            yield done()

    return dealt.mapInPandas(sums, "record_id string, draw int, u0 double, n double, logs array<double>")


def grid_draws(times: DataFrame, low: float, high: float, draws: int, seed: int, least: int = LEAST) -> DataFrame:
    """Draws (record_id, draw, p_boot): grid fits of a record's events (usgs_id, t_days), each taken a Poisson number of times.

    The number is that of the MD5 of (seed, draw, record, event), so SQL can
    repeat it. Events are read once and are not copied for the draws; a draw
    of fewer than ``least`` events gives no fit.
    """
    cs, ps, numbers = np.array(c_grid()), np.array(p_grid()), np.arange(1, draws + 1)
    ends = np.array([math.ceil(x * 2.0**32) for x in _poisson_ends(10)], dtype=np.uint32)
    inside = times.where(F.col("t_days").between(low, high)).select("record_id", "usgs_id", "t_days")

    def weights(record: str, own: pd.DataFrame) -> np.ndarray:
        suffixes = [b"" if x is None else f"|{x}".encode() for x in own["usgs_id"].tolist()]  # null parts are left out
        return _reached(md5_leading([f"{seed}|{k}|{record}".encode() for k in numbers], suffixes), ends)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, p = cs[:, None], ps[None, :]
        near = np.abs(p - 1) <= 1e-6
        area = np.where(near, np.log((high + c) / (low + c)), (np.power(high + c, 1 - p) - np.power(low + c, 1 - p)) / np.where(near, 1.0, 1 - p))
        for batch in batches:
            for at in range(0, len(batch), 256):
                own = batch.iloc[at : at + 256]
                n = own["n"].to_numpy()[:, None, None]
                nll = n - n * np.log(n / area) + p * np.stack(own["logs"].to_numpy())[:, :, None]
                place = np.argmin(np.round(nll, 9).reshape(len(own), -1), axis=1)
                yield pd.DataFrame({"record_id": own["record_id"], "draw": own["draw"], "p_boot": ps[place % len(ps)]})

    records = inside.groupBy("record_id").agg(F.lit(0.0).alias("u0"), F.count("*").alias("n_events"))
    parts = _draw_sums(inside, records, "usgs_id", numbers, weights, lambda u0: cs, DIGEST_BLOCK)
    return together(parts, ["record_id", "draw"], {"logs": C_STEPS}).where(F.col("n") >= least).mapInPandas(best, "record_id string, draw int, p_boot double")


def bootstrap(times: DataFrame, fits: DataFrame, low: float, high: float, draws: int = 200, seed: int = 7) -> DataFrame:
    """Draws (record_id, draw, p_boot): refits of a record's events resampled with replacement.

    In a draw each event counts a Poisson number of times with mean one, a
    hash of (event, draw, seed): so a record's events are resampled wherever
    they lie, and only sums for each draw are shuffled. A draw is fitted at
    DRAW_STEPS values of c about the record's own and between the best three.
    """
    offsets = np.linspace(-REACH, REACH, DRAW_STEPS)
    ends = math.log(C_RANGE[0]), math.log(C_RANGE[1])
    event = [c for c in ("usgs_id", "t_days") if c in times.columns]
    keyed = times.where(F.col("t_days").between(low, high)).select("record_id", "t_days", F.xxhash64(*event).alias("key"))
    if "n_events" not in fits.columns:
        fits = fits.join(keyed.groupBy("record_id").agg(F.count("*").alias("n_events")), "record_id")
    cdf, numbers = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), np.arange(draws)

    def weights(record: str, own: pd.DataFrame) -> np.ndarray:
        return _reached(_uniform(own["key"].to_numpy().view(np.uint64), numbers, seed), cdf).T

    parts = _draw_sums(keyed, fits.select("record_id", F.log("c").alias("u0"), "n_events"), "key", numbers, weights, lambda u0: np.exp(np.clip(u0 + offsets, *ends)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["n"] > 0]
            if not len(batch):
                continue
            u = np.clip(batch["u0"].to_numpy()[:, None] + offsets[None, :], *ends)
            nll, p = best_p(np.exp(u), batch["n"].to_numpy()[:, None], np.stack(batch["logs"].to_numpy()), low, high)
            rows, at = np.arange(len(batch)), np.clip(np.argmin(nll, axis=1), 1, DRAW_STEPS - 2)
            (a, b, d), (pa_, pb, pd_) = ([x[rows, at + k] for k in (-1, 0, 1)] for x in (nll, p))
            bend = a - 2 * b + d
            shift = np.clip(np.where(bend > 0, (a - d) / (2 * np.where(bend > 0, bend, 1.0)), np.where(a < d, -1.0, 1.0)), -1, 1)
            shift = np.where(u[rows, at + 1] > u[rows, at - 1], shift, 0.0)
            value = pb + shift * (pd_ - pa_) / 2 + shift**2 * (pa_ - 2 * pb + pd_) / 2
            yield pd.DataFrame({"record_id": batch["record_id"], "draw": batch["draw"].astype("int32"), "p_boot": np.clip(value, *P_RANGE)})

    return together(parts, ["record_id", "u0", "draw"], {"logs": DRAW_STEPS}).mapInPandas(solve, "record_id string, draw int, p_boot double")


def intervals(draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Number of draws, their 2.5, 50 and 97.5 % points (exact, linear between ranks) and share below zero."""
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return draws.groupBy(*by).agg(F.count(value).alias("n_draws"), ends.alias("q"), F.avg((F.col(value) < 0).cast("double")).alias("below_zero")).select(*by, "n_draws", F.col("q")[0].alias("p_lo"), F.col("q")[1].alias("p_median"), F.col("q")[2].alias("p_hi"), "below_zero")


def relaxed(whole: DataFrame, fits: DataFrame, enough: int = 6) -> DataFrame:
    """Rows ``all_relaxed`` for mainshocks with fewer than ``enough`` fitted subgroups, none among them too.

    ``whole``: fits of all events of a mainshock, under the lower gate that
    such rows have.
    """
    full = fits.groupBy("mainshock_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= enough).select("mainshock_id")
    own = whole.join(full, "mainshock_id", "left_anti")
    return own.withColumns({"subgroup_type": F.lit("depth"), "subgroup": F.lit("all_relaxed"), "record_id": F.concat_ws("|", "mainshock_id", F.lit("depth"), F.lit("all_relaxed"))})


def binned_rate(times: DataFrame, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Events a day in logarithmic bins of time; empty bins are 0, the last is closed."""
    span = math.log(high / low)
    place = F.least(F.floor(F.log(F.col("t_days") / low) * bins / span), F.lit(bins - 1)).cast("int")
    counts = times.where(F.col("t_days").between(low, high)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    every = times.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    start, end = F.lit(low) * F.exp(F.col("bin") * span / bins), F.lit(low) * F.exp((F.col("bin") + 1) * span / bins)
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / (end - start)).alias("rate"))
