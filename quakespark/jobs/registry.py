"""All queries of the library by name, with their SQL equivalents.

``events`` is read as the catalog and ``orders`` as the population grid. The
tables of the study (mainshocks, aftershocks, subgroups, samples) are made once
for a session and folder and shared by its queries, as a study's jobs do. In
the statistics queries p is the decay exponent of the likelihood's best grid
point, which SQL can find as well; the omori_* queries take the refined fits,
with their bootstrap, through exposure, regression and prediction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.functions.geo import half_planes
from quakespark.functions.labels import depth_group, interval_label
from quakespark.jobs import oracles, studies
from quakespark.operators import catalog as cat
from quakespark.operators import exposure, logo, omori, resample, segments, stats
from quakespark.sources import adapters, geojson, grid, sinks
from quakespark.sources.tables import made_once, scratch_dir, settle, together

P = oracles.PARAMETERS
RECORD = ["record_id", "mainshock_id", "subgroup_type", "subgroup"]


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return adapters.catalog(spark, d)


def _candidates(spark, d):
    return cat.search(_catalog(spark, d), P["lat"], P["lon"], min_mag=P["candidate_mag"])


_mainshocks = made_once("mainshocks", lambda spark, d: cat.decluster(_candidates(spark, d), P["window_days"], P["most"]))


def _joined(spark, d) -> DataFrame:
    return cat.aftershocks(_catalog(spark, d), _mainshocks(spark, d), P["radius_km"], P["days"], P["min_mag"])


_aftershocks = made_once("aftershocks", _joined)
_rings = made_once("rings", lambda spark, d: segments.merged_rings(_aftershocks(spark, d), P["rings"], P["least"]))


def _shocks(spark, d) -> DataFrame:
    """The columns of the mainshocks that have aftershocks."""
    return _aftershocks(spark, d).groupBy("mainshock_id").agg(F.first("mainshock_mag").alias("mainshock_mag"), F.first("c_lat").alias("c_lat"), F.first("c_lon").alias("c_lon"))


def _with_exposure(spark, d, fits: DataFrame) -> DataFrame:
    shocks = settle(_shocks(spark, d), "shocks")
    pop = exposure.subgroup_exposure(adapters.pixels(spark, d), shocks, fits, P["radius_km"])
    return fits.join(pop, RECORD[1:], "left").join(shocks.select("mainshock_id", "mainshock_mag"), "mainshock_id", "left")


def _grid_subgroups(spark, d) -> DataFrame:
    """Grid fits of fixed depth groups, half-planes and merged rings; an event is added up once, in its cell of all three."""
    events = segments.placed(_aftershocks(spark, d), _rings(spark, d), P["depths"])
    n, cs = omori.C_STEPS, omori.c_grid()
    cells = settle(together(omori.log_parts(events, segments.CELL, cs, P["tmin"], P["days"]), segments.CELL, {"sums": n}, also="_all"), "log_cells")
    fits = omori.best_of_grid(omori.gated(segments.of_cells(cells), RECORD, n, omori.LEAST, P["least"]), RECORD, P["tmin"], P["days"])
    return _with_exposure(spark, d, settle(fits.select(*RECORD, "n_events", "p"), "fits"))


_subgroups = made_once("subgroups", _grid_subgroups)


def _sampled(subgroups: DataFrame) -> DataFrame:
    return stats.with_terms(stats.analysis_sample(subgroups, P["radius_km"], P["least"]))


_sample = made_once("sample", lambda spark, d: _sampled(_subgroups(spark, d)))


def _shock_rows(spark, d) -> DataFrame:
    events = _aftershocks(spark, d)
    fits = omori.grid_fit(events, ["mainshock_id"], P["tmin"], P["days"], raw=P["least_mainshock"]).select("mainshock_id", "n_events", "p")
    pop = exposure.buffers(adapters.pixels(spark, d), cat.mainshock_columns(_mainshocks(spark, d)), list(P["buffers"]))
    rows = fits.join(_shocks(spark, d).select("mainshock_id", "mainshock_mag"), "mainshock_id")
    return stats.merge_with_exposure(rows, pop.withColumnRenamed("mainshock_id", "usgs_id"), "mainshock_id", "usgs_id")


_mainshock_rows = made_once("mainshock_rows", _shock_rows)


def _drawn(spark, d) -> DataFrame:
    """P['draws'] draws for each mainshock: the decay exponent of its aftershocks, each taken a Poisson number of times."""
    events = _aftershocks(spark, d).select(F.col("mainshock_id").alias("record_id"), "usgs_id", "t_days")
    return omori.grid_draws(events, P["tmin"], P["days"], P["draws"], P["seed"])


_draws = made_once("draws", _drawn)


# ---- the refined fits


def _fitted(spark, d) -> DataFrame:
    """Fits of every subgroup of mainshocks with enough events, relaxed rows too."""
    events = _aftershocks(spark, d)
    enough = events.groupBy("mainshock_id").agg(F.count("*").alias("n")).where(F.col("n") >= P["least_mainshock"]).select("mainshock_id")
    events = events.join(settle(enough, "enough"), "mainshock_id", "left_semi")
    dealt = segments.expand(events, _rings(spark, d), segments.depth_segments(events, P["least"]))
    fits = omori.fit(dealt, RECORD, P["tmin"], P["days"], raw=P["least"])
    return fits.unionByName(omori.relaxed(omori.fit(events, ["mainshock_id"], P["tmin"], P["days"], raw=P["least_relaxed"]), fits))


_fits = made_once("omori_fits", _fitted)


def _resampled(spark, d) -> DataFrame:
    """P['draws'] bootstrap draws for each fitted subgroup; relaxed rows have none."""
    events = _aftershocks(spark, d)
    dealt = segments.expand(events, _rings(spark, d), segments.depth_segments(events, P["least"]), carry=("t_days", "usgs_id"))
    return omori.bootstrap(dealt, _fits(spark, d).where("subgroup <> 'all_relaxed'"), P["tmin"], P["days"], P["draws"], P["seed"])


_boots = made_once("omori_draws", _resampled)


def _decay(spark, d) -> DataFrame:
    ends = omori.intervals(_boots(spark, d), "p_boot", ["record_id"]).select("record_id", "p_lo", "p_hi")
    return _with_exposure(spark, d, _fits(spark, d).join(ends, "record_id", "left"))


_decays = made_once("omori_subgroups", _decay)
_decay_sample = made_once("omori_sample", lambda spark, d: _sampled(_decays(spark, d)))


def r(c: str, k: int = 6):
    return F.round(F.col(c), k).alias(c)


# ---- catalog


def event_catalog(spark, d):
    return _catalog(spark, d).select("usgs_id", "time_us", r("lat", 9), r("lon", 9), "depth_km", r("mag", 9), "place")


def geojson_roundtrip(spark, d):
    path = f"{scratch_dir(spark)}/geojson-{uuid.uuid4().hex}"
    whole = _catalog(spark, d).withColumn("time_us", F.floor(F.col("time_us") / 1000) * 1000)
    geojson.write_collections(whole, F.date_format("time_utc", "yyyy-MM-dd"), path)
    return geojson.to_catalog(geojson.read_collections(spark, path)).select("usgs_id", "time_us", r("lat", 9), r("lon", 9), "depth_km", r("mag", 9), "place")


def bbox_search(spark, d):
    return cat.search(_catalog(spark, d), (25.0, 30.0), (99.0, 103.0), "2024-01-05", "2024-01-20", 2.0).select("usgs_id", "time_us", r("mag", 9))


def mainshock_top1(spark, d):
    return cat.strongest(_catalog(spark, d), ["place"]).select("place", "usgs_id", "time_us", r("mag", 9))


def declustered_mainshocks(spark, d):
    return _mainshocks(spark, d).select("usgs_id", "time_us", r("mag", 9))


def aftershock_join(spark, d):
    return _joined(spark, d).select("mainshock_id", "usgs_id", r("t_days"), r("dist_km"))


def catalog_clean(spark, d):
    """What a download of each mainshock's circle holds, a day before it too, cleaned."""
    around = cat.mainshock_columns(_mainshocks(spark, d)).withColumn("ms_time_us", F.col("ms_time_us") - cat.DAY_US)
    runs = cat.near_pairs(_catalog(spark, d), around, P["radius_km"], span_us=int((P["days"] + 1) * cat.DAY_US)).withColumnRenamed("mainshock_id", "run")
    kept = cat.clean_run(runs.select("run", *_catalog(spark, d).columns), _mainshocks(spark, d), True)
    return kept.groupBy("mainshock_id").agg(F.count("*").alias("n_events"), F.round(F.min("t_days"), 6).alias("first_days"), F.round(F.sum("t_days"), 3).alias("sum_days"))


def catalog_summary(spark, d):
    s = cat.summary(_joined(spark, d), ["mainshock_id"])
    return s.select("mainshock_id", "n_rows", *[r(c) for c in s.columns[2:]])


def events_per_mainshock(spark, d):
    found = cat.run_index(_mainshocks(spark, d), _joined(spark, d), radius_km=P["radius_km"], days_after=P["days"], minmag=P["min_mag"])
    return found.withColumns({c: r(c, 9) for c in ("mag", "lat", "lon")})


def mainshock_list(spark, d):
    """The mainshocks written as a list and read back."""
    path = f"{scratch_dir(spark)}/mainshocks-{uuid.uuid4().hex}"
    sinks.write_mainshocks(_mainshocks(spark, d), path)
    return sinks.read_mainshocks(spark, path, lines=True).select("usgs_id", "time_us", r("lat", 9), r("lon", 9), "depth_km", r("mag", 9), "place")


def circle_boxes(spark, d):
    b = cat.boxes(_mainshocks(spark, d), P["radius_km"])
    return b.select("mainshock_id", *[r(c) for c in b.columns[1:]])


# ---- subgroups


def depth_group_counts(spark, d):
    return _joined(spark, d).groupBy("mainshock_id", depth_group(F.col("depth_km"), P["depths"]).alias("depth_group")).agg(F.count("*").alias("n"))


def half_plane_counts(spark, d):
    e = _joined(spark, d)
    return e.select("mainshock_id", F.explode(half_planes(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).alias("region")).groupBy("mainshock_id", "region").agg(F.count("*").alias("n"))


def region_predicate_counts(spark, d):
    regions = {"West_of_lon0": F.col("lon") < 101.5, "East_of_lon0": F.col("lon") >= 101.5, "South_of_lat0": F.col("lat") < 28.5, "North_of_lat0": F.col("lat") >= 28.5}
    return segments.expand(_joined(spark, d), regions=regions).where("subgroup_type = 'region'").groupBy("mainshock_id", "subgroup").agg(F.count("*").alias("n"))


def aftershock_ring_counts(spark, d):
    return segments.ring_counts(_joined(spark, d), list(P["rings"])).select("mainshock_id", F.col("ring").cast("int").alias("ring"), "n")


def merged_rings(spark, d):
    return _rings(spark, d)


def depth_segments(spark, d):
    return _shown_depths(segments.depth_segments(_aftershocks(spark, d), P["least"]))


def depth_segments_binned(spark, d):
    return _shown_depths(segments.depth_segments(_aftershocks(spark, d), P["least"], bins=P["depths"]))


def _shown_depths(found):
    return found.select("mainshock_id", interval_label(F.col("lo"), F.col("hi")).alias("segment"), F.round("lo", 6).alias("lo"), F.when(F.col("hi") < float("inf"), F.round("hi", 6)).alias("hi"), "first")


def subgroup_expand(spark, d):
    return segments.expand(_aftershocks(spark, d), _rings(spark, d)).groupBy("record_id", "subgroup_type", "subgroup").agg(F.count("*").alias("n"))


# ---- decay


def omori_nll(spark, d):
    return omori.negative_log_likelihood(_joined(spark, d), ["mainshock_id"], 50.0, 0.05, 1.1, P["tmin"], P["days"]).select("mainshock_id", "n_events", r("nll", 4))


def omori_grid_fit(spark, d):
    f = omori.grid_fit(_joined(spark, d), ["mainshock_id"], P["tmin"], P["days"])
    return f.select("mainshock_id", "n_events", r("k", 4), r("c", 9), r("p"), r("nll", 4))


def omori_mle(spark, d):
    return _fits(spark, d).select(*RECORD, "n_events", r("k", 3), r("c", 4), r("p", 3), r("nll", 4))


def _single(spark, d) -> DataFrame:
    """One catalog with its own magnitude of completeness and start."""
    return _aftershocks(spark, d).where(F.col("mag") >= 2.0)


def _with_intervals(times: DataFrame, name: str, raw: int) -> DataFrame:
    """Fits by ``name`` over 0.05 days to the last event, with bootstrap intervals."""
    end = float(times.agg(F.max("t_days")).first()[0] or 0.0)
    fits = omori.fit(times, [name], 0.05, end, raw=raw)
    named = times.withColumn("record_id", F.col(name))
    draws = omori.bootstrap(named, fits.withColumn("record_id", F.col(name)), 0.05, end, P["draws"], P["seed"])
    ends = omori.intervals(draws, "p_boot", ["record_id"]).withColumnRenamed("record_id", name)
    return fits.join(ends, name, "left").select(name, "n_events", r("p", 3), r("nll", 4), r("p_lo", 3), r("p_hi", 3))


def omori_single(spark, d):
    """By fixed depth group, of at least 50 events."""
    return _with_intervals(_single(spark, d).withColumn("depth_group", depth_group(F.col("depth_km"), P["depths"])), "depth_group", 50)


def omori_single_regions(spark, d):
    """By region (predicates that the user names), of at least 80 events."""
    e = _single(spark, d)
    regions = {"West_of_lon0": F.col("lon") < 101.5, "East_of_lon0": F.col("lon") >= 101.5, "South_of_lat0": F.col("lat") < 28.5, "North_of_lat0": F.col("lat") >= 28.5}
    dealt = segments.expand(e, regions=regions, carry=("t_days", "usgs_id")).where("subgroup_type = 'region'")
    return _with_intervals(dealt.select(F.col("subgroup").alias("region"), "t_days", "usgs_id"), "region", 80)


def omori_single_all(spark, d):
    """All events of the catalog."""
    return _with_intervals(_single(spark, d).withColumn("scope", F.lit("all")), "scope", 0)


def omori_sensitivity(spark, d):
    f = omori.sensitivity(_aftershocks(spark, d), [1.0, 1.5, 2.0, 2.5], [0.01, 0.05, 0.1], P["days"])
    return f.select("mc", "tmin_days", "n_events", r("p", 3), r("nll", 4))


def omori_bootstrap(spark, d):
    found = omori.intervals(_boots(spark, d), "p_boot", ["record_id"])
    return found.select("record_id", "n_draws", r("p_lo", 3), r("p_median", 3), r("p_hi", 3), "below_zero")


def omori_subgroups(spark, d):
    """Each subgroup's fit with its interval and its people."""
    return _decays(spark, d).select(*RECORD, "n_events", r("p", 3), r("p_lo", 3), r("p_hi", 3), r("mainshock_mag"), r("pop_sum_subgroup", 4))


def omori_fe(spark, d):
    """The fixed-effects model of the refined p, and the exposure slope's interval with whole mainshocks drawn."""
    sample = _decay_sample(spark, d)
    boot = resample.cluster_bootstrap_fe(sample, P["reps_fe"], P["seed"])
    ends = omori.intervals(boot.withColumn("term", F.lit("log10_pop")), "slope", ["term"]).withColumnsRenamed({"p_lo": "boot_lo", "p_median": "boot_median", "p_hi": "boot_hi"})
    found = stats.within_fe(sample).join(F.broadcast(ends), "term", "left")  # one row
    return found.select(*[c if t != "double" else r(c, 4) for c, t in found.dtypes])


def omori_permutation(spark, d):
    found = resample.permutation_summary(resample.permutation_slopes(_decay_sample(spark, d), P["reps_permutation"], P["seed"]), [])
    return found.select(r("observed", 4), "n_perm", r("p_value", 4), r("null_mean", 4), r("null_lo", 4), r("null_hi", 4))


def omori_logo(spark, d):
    _, predictions = logo.compare(_decay_sample(spark, d))
    found = logo.metrics(predictions)
    return found.select("model", "n", *[r(c, 4) for c in found.columns[2:]])


def fits_roundtrip(spark, d):
    """Fits of subgroups and mainshocks written as nested sections, and the mainshocks' section read back."""
    fits = _subgroups(spark, d).select(*RECORD, "n_events", "p")
    whole = _mainshock_rows(spark, d).select(F.concat_ws("|", "mainshock_id", F.lit("mainshock"), F.lit("all")).alias("record_id"), "mainshock_id", F.lit("mainshock").alias("subgroup_type"), F.lit("all").alias("subgroup"), "n_events", "p")
    path = f"{scratch_dir(spark)}/fits-{uuid.uuid4().hex}"
    sinks.write_json(sinks.nested_fits(fits.unionByName(whole), {"Mc": P["min_mag"], "tmin_days": P["tmin"], "tmax_days": P["days"]}), path)
    return sinks.read_fits(spark, path, "by_mainshock", "record_id string, n_events long, p double").select("mainshock_id", "record_id", "n_events", r("p"))


def bootstrap_intervals(spark, d):
    found = omori.intervals(_draws(spark, d), "p_boot", ["record_id"])
    return found.select("record_id", "n_draws", r("p_lo"), r("p_median"), r("p_hi"), "below_zero")


def binned_rate(spark, d):
    return omori.binned_rate(_aftershocks(spark, d), ["mainshock_id"], P["tmin"], P["days"], 20).select("mainshock_id", "bin", "n", r("rate"))


# ---- exposure and samples


def buffer_exposure(spark, d):
    b = exposure.buffers(adapters.pixels(spark, d), cat.mainshock_columns(_mainshocks(spark, d)), list(P["buffers"]))
    return b.select("mainshock_id", *[r(c, 4) for c in b.columns[1:]])


def tiled_exposure(spark, d):
    """buffer_exposure from a grid written by tile, of which only the circles' tiles are read."""
    path = f"{scratch_dir(spark)}/grid-{uuid.uuid4().hex}"
    grid.write_grid(adapters.pixels(spark, d), path)
    b = exposure.buffers(grid.read_grid(spark, path), cat.mainshock_columns(_mainshocks(spark, d)), list(P["buffers"]), grid.grid_pixels)
    return b.select("mainshock_id", *[r(c, 4) for c in b.columns[1:]])


def subgroup_exposure(spark, d):
    s = _subgroups(spark, d)
    return s.select("record_id", *[r(f"pop_{k}_subgroup", 4) for k in ("sum", "mean", "max")])


def mainshock_summary(spark, d):
    m = _mainshock_rows(spark, d)
    return m.select("mainshock_id", "n_events", r("p"), r("mainshock_mag"), *[r(f"pop_sum_{k}km", 4) for k in P["buffers"]])


def subgroup_summary(spark, d):
    b = exposure.buffers(adapters.pixels(spark, d), cat.mainshock_columns(_mainshocks(spark, d)), list(P["buffers"]))
    s = _subgroups(spark, d).join(b, "mainshock_id", "left")
    return s.select("record_id", "mainshock_id", "subgroup_type", "subgroup", "n_events", r("p"), r("pop_sum_subgroup", 4), r("pop_sum_50km", 4))


def analysis_sample(spark, d):
    return _sample(spark, d).select("record_id", "n_events", r("p"), r("pop_sum_subgroup", 4), "analysis_included")


def line_fit(spark, d):
    """The line of p on log10 of the people within 50 km, over the mainshocks."""
    rows = _mainshock_rows(spark, d).where("pop_sum_50km > 0").withColumns({"x": F.log10("pop_sum_50km"), "scope": F.lit("mainshock")})
    return stats.correlations(rows, "x", "p", ["scope"]).select("scope", "n", r("slope"), r("intercept"))


def features(spark, d):
    made, names = logo.features(_sample(spark, d))
    shown = ["log10_pop", "log_n_events", "ring_mid_km", "depth_mid_km", "type_depth", "type_region", "type_ring", "region_West_of_ms"]
    return made.select("record_id", *[F.round(F.col(n) if n in names else F.lit(0.0), 6).alias(n) for n in shown])


# ---- correlations and regressions


def corr_pearson_spearman(spark, d):
    s = _sample(spark, d)
    found = stats.correlations(s, "log10_pop", "p", ["subgroup_type"])
    return found.select("subgroup_type", "n", r("pearson_r"), r("spearman_rho"), r("slope"))


def corr_p_values(spark, d):
    found = stats.correlations(_sample(spark, d), "log10_pop", "p", ["subgroup_type"])
    return found.select("subgroup_type", F.round(stats.correlation_p("pearson_r", "n"), 8).alias("pearson_p"), F.round(stats.correlation_p("spearman_rho", "n"), 8).alias("spearman_p"))


def controlled_ols(spark, d):
    found = stats.ols(_sample(spark, d), "p", ["log10_pop", "log_n_events"]).where("term <> 'const'")
    return found.select("term", r("coef"), r("se"), r("t", 5), "n", "dof", r("r2"), r("adj_r2"))


def controlled_ols_full(spark, d):
    found = stats.controlled(_sample(spark, d))
    return found.select(*[c if t not in ("double",) else r(c) for c, t in found.dtypes])


def controlled_ols_effects(spark, d):
    found = stats.controlled(_sample(spark, d), effects=True)
    return found.select(*[c if t not in ("double",) else r(c) for c, t in found.dtypes])


def within_fe(spark, d):
    found = stats.within_fe(_sample(spark, d))
    return found.select(*[c if t not in ("double",) else r(c) for c, t in found.dtypes])


def within_fe_slope(spark, d):
    found = resample.permutation_slopes(_sample(spark, d), 1, P["seed"]).where("rep = 0")
    return found.select(F.round("slope", 6).alias("slope"))


def loo_corr(spark, d):
    found = resample.leave_one_out(_sample(spark, d), "log10_pop", "p", "mainshock_id")
    return found.select("omitted", "n", r("pearson_r"), r("spearman_rho"))


def cluster_boot_corr(spark, d):
    found = resample.cluster_bootstrap_correlation(_sample(spark, d), "log10_pop", "p", "mainshock_id", P["reps_corr"], P["seed"])
    return found.select("rep", "n", r("pearson_r"), r("spearman_rho"))


def cluster_boot_fe(spark, d):
    found = resample.cluster_bootstrap_fe(_sample(spark, d), P["reps_fe"], P["seed"])
    return found.select("rep", r("slope"))


def within_permute(spark, d):
    found = resample.permute_within(_sample(spark, d), "pop_sum_subgroup", "mainshock_id", "record_id", P["reps"], P["seed"])
    return found.select("rep", "mainshock_id", "record_id", r("pop_sum_subgroup", 4))


def permutation_test(spark, d):
    found = resample.permutation_summary(resample.permutation_slopes(_sample(spark, d), P["reps_permutation"], P["seed"]), [])
    return found.select(r("observed"), "n_perm", r("p_value"), r("null_mean"), r("null_lo"), r("null_hi"))


def exact_permutation(spark, d):
    rows = _mainshock_rows(spark, d).where("pop_sum_50km > 0").withColumn("x", F.log10("pop_sum_50km")).withColumn("study", F.lit("all"))
    found = resample.order_permutation(rows, "x", "p", ["study"], seed=P["seed"])
    return found.select("study", "n_orders", r("observed"), r("p_value"), r("null_lo"), r("null_hi"))


def draw_histogram(spark, d):
    return stats.histogram(_draws(spark, d), "p_boot", 25, ["record_id"])


def draw_matrix(spark, d):
    draws = _draws(spark, d)
    return resample.draw_matrix(draws.select("record_id").distinct(), draws, 30, P["seed"]).select("record_id", "rep", r("p"))


# ---- prediction


def logo_splits(spark, d):
    return logo.splits(_sample(spark, d).select("record_id", "mainshock_id"), "mainshock_id").select("test_group", "record_id", "is_test")


def logo_compare(spark, d):
    _, predictions = logo.compare(_sample(spark, d))
    found = logo.metrics(predictions)
    return found.select("model", "n", *[r(c) for c in found.columns[2:]])


def logo_folds(spark, d):
    models, predictions = logo.compare(_sample(spark, d))
    found = stats.errors(predictions, "p", "predicted", ["mainshock_id", "model"])
    return found.join(models.select(F.col("test_group").alias("mainshock_id"), "model", "alpha"), ["mainshock_id", "model"]).select("mainshock_id", "model", "alpha", "n", r("mae"), r("rmse"), r("r2"), r("target_sd"))


def train_bins(spark, d):
    return logo.train_bins(_sample(spark, d), "p", "mainshock_id").select("test_group", r("q1"), r("q2"))


def _mean_predictions(spark, d) -> DataFrame:
    """Each row with the mean of its kind's other rows as prediction, and both as classes."""
    s = _sample(spark, d)
    kind = Window.partitionBy("subgroup_type")
    rows = s.withColumn("predicted", F.try_divide(F.sum("p").over(kind) - F.col("p"), F.count("*").over(kind) - 1)).where("predicted IS NOT NULL")
    bins = settle(logo.train_bins(rows, "p", "mainshock_id"), "bins")
    return logo.classes(logo.classes(rows, bins, "p", "mainshock_id", "true_class"), bins, "predicted", "mainshock_id", "pred_class")


def class_metrics(spark, d):
    found = stats.class_metrics(_mean_predictions(spark, d), "true_class", "pred_class", ["subgroup_type"])
    return found.select("subgroup_type", r("accuracy"), r("macro_f1"))


def confusion(spark, d):
    return stats.confusion(_mean_predictions(spark, d), "true_class", "pred_class", [])


def ridge_confusion(spark, d):
    return stats.confusion(logo.ridge_classes(logo.compare(_sample(spark, d))[1]), "true_class", "pred_class", [])


def fold_metrics(spark, d):
    found = stats.errors(_mean_predictions(spark, d), "p", "predicted", ["mainshock_id"])
    return found.select("mainshock_id", "n", r("mae"), r("rmse"), r("r2", 5), r("target_sd"))


def perm_importance(spark, d):
    return logo.importance(_sample(spark, d), 5, P["seed"]).select("feature", r("delta_rmse"))


# ---- studies


def scale_sensitivity(spark, d):
    found = studies.scale_study(_mainshock_rows(spark, d), P["buffers"])
    return found.select(*[c if t != "double" else r(c) for c, t in found.dtypes])


def scale_correlations(spark, d):
    found = stats.correlations(studies.by_radius(_mainshock_rows(spark, d), P["buffers"]), "x", "p", ["radius_km"])
    return found.select("radius_km", "n", r("pearson_r"), r("spearman_rho"), r("slope"))


def uncertainty(spark, d):
    """The analysis for P['reps_uncertainty'] picks from every subgroup's bootstrap draws of the refined p."""
    found = studies.uncertainty_summary(studies.uncertainty(_decay_sample(spark, d), _boots(spark, d), P["reps_uncertainty"], P["seed"]))
    return found.select("metric", "n_draws", r("p_lo", 4), r("p_median", 4), r("p_hi", 4), r("below_zero", 4))


def influence_subgroup(spark, d):
    found = studies.subgroup_influence(_sample(spark, d), P["reps_influence"], P["seed"])
    return found.select(*[c if t != "double" else r(c) for c, t in found.dtypes])


def influence_scale(spark, d):
    found = studies.scale_influence(_mainshock_rows(spark, d), P["buffers"])
    return found.select(*[c if t != "double" else r(c) for c, t in found.dtypes])


def influence_range(spark, d):
    loo = resample.leave_one_out_pearson(_sample(spark, d), "log10_pop", "p", "mainshock_id").where("omitted <> '(none)'")
    found = studies.influence_summary(loo, "pearson_r", [])
    return found.select("n", r("least"), r("greatest"), r("share_negative"), r("share_positive"))


def report_facts(spark, d):
    found = studies.report_facts(_sample(spark, d), _mainshock_rows(spark, d), P["reps_permutation"], P["seed"])
    return found.select("n_rows", "n_groups", "n_records", "n_mainshocks", "n_perm", "slopes_agree")


def report_facts_all(spark, d):
    """Every fact of the report, of the study with the refined fits; maps as JSON."""
    sample, shocks = _decay_sample(spark, d), _mainshock_rows(spark, d)
    tested = resample.permutation_summary(resample.permutation_slopes(sample, P["reps_permutation"], P["seed"]), [])
    propagated = studies.uncertainty_summary(studies.uncertainty(sample, _boots(spark, d), P["reps_uncertainty"], P["seed"]))
    found = studies.all_facts(
        sample, resample.cluster_bootstrap_fe(sample, P["reps_fe"], P["seed"]), tested, propagated, logo.metrics(logo.compare(sample)[1]),
        studies.scale_study(shocks, P["buffers"]), studies.influence(sample, shocks, P["reps_influence"], P["seed"], exact=False),  # no fact is a permutation p of these
    )
    return found.select(*[r(c, 4) if t == "double" else F.to_json(c).alias(c) if t.startswith(("map", "array")) else c for c, t in found.dtypes])


def draws_roundtrip(spark, d):
    """The draw table written, and the draws of all records read back."""
    path = f"{scratch_dir(spark)}/draws-{uuid.uuid4().hex}"
    draws = _draws(spark, d)
    sinks.write_draws(draws.withColumn("record_id", F.concat_ws("|", "record_id", F.lit("mainshock"), F.lit("all"))), path)
    return sinks.read_draws(spark, path).select("record_id", "mainshock_id", "subgroup_type", "subgroup", "draw", r("p_boot"))


QUERIES = {
    f.__name__: f
    for f in (
        event_catalog, geojson_roundtrip, mainshock_list, fits_roundtrip, draws_roundtrip, bbox_search, mainshock_top1, declustered_mainshocks, aftershock_join, catalog_clean, catalog_summary, events_per_mainshock, circle_boxes,
        depth_group_counts, half_plane_counts, region_predicate_counts, aftershock_ring_counts, merged_rings, depth_segments, depth_segments_binned, subgroup_expand,
        omori_nll, omori_grid_fit, omori_mle, omori_single, omori_single_regions, omori_single_all, omori_sensitivity, omori_bootstrap, omori_subgroups, omori_fe, omori_permutation, omori_logo, bootstrap_intervals, binned_rate,
        buffer_exposure, tiled_exposure, subgroup_exposure, mainshock_summary, subgroup_summary, analysis_sample, line_fit, features,
        corr_pearson_spearman, corr_p_values, controlled_ols, controlled_ols_full, controlled_ols_effects, within_fe, within_fe_slope, loo_corr, cluster_boot_corr, cluster_boot_fe, within_permute, permutation_test, exact_permutation, draw_histogram, draw_matrix,
        logo_splits, logo_compare, logo_folds, train_bins, class_metrics, confusion, ridge_confusion, fold_metrics, perm_importance,
        scale_sensitivity, scale_correlations, uncertainty, influence_subgroup, influence_scale, influence_range, report_facts, report_facts_all,
    )
}

ORACLES = oracles.ORACLES
