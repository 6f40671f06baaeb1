"""Whole studies put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.operators import logo, resample, stats
from quakespark.operators.omori import intervals
from quakespark.sources.adapters import finite
from quakespark.sources.tables import settle

RADII = (10, 25, 50)


def by_radius(mainshocks: DataFrame, radii=RADII) -> DataFrame:
    """A row for each mainshock and radius with the study's terms; incomplete and non-positive rows are left out."""
    stacked = F.explode(F.array(*[F.struct(F.lit(r).alias("radius_km"), finite(F.col(f"pop_sum_{r}km").cast("double")).alias("pop")) for r in radii]))
    others = [c for c in mainshocks.columns if not c.startswith("pop_")]
    long = mainshocks.select(*others, stacked.alias("s")).select(*others, "s.*").withColumn("p", finite(F.col("p").cast("double")))
    kept = long.where("p > 0 AND n_events > 0 AND pop > 0 AND mainshock_mag IS NOT NULL")
    return kept.withColumns({"x": F.log10("pop"), "log_n": F.log(F.col("n_events").cast("double"))})


def correlation_range(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, loo_min, loo_max): the range of the correlation as each row is left out, from the group's moments less the row's."""
    n = F.count("*").cast("double")
    whole = rows.groupBy(*by).agg(n.alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.var_pop(x) * n).alias("_xx"), (F.var_pop(y) * n).alias("_yy"), (F.covar_pop(x, y) * n).alias("_xy"))
    dx, dy, share = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.try_divide(F.col("_n"), F.col("_n") - 1)
    xx, yy, xy = F.col("_xx") - share * dx * dx, F.col("_yy") - share * dy * dy, F.col("_xy") - share * dx * dy
    moves = (xx > 1e-12 * F.col("_xx")) & (yy > 1e-12 * F.col("_yy"))
    r = F.when(moves, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(xy, F.sqrt(F.when(moves, xx * yy))))))
    return rows.join(whole, by).groupBy(*by).agg(F.min(r).alias("loo_min"), F.max(r).alias("loo_max"))


def scale_study(mainshocks: DataFrame, radii=RADII, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """By radius (and ``by``): correlations with p-values, exact permutation p, range when one is left out, model errors."""
    keys = [*(by or []), "radius_km"]
    rows = settle(by_radius(mainshocks, radii).withColumn("_key", F.concat_ws("|", *keys)), "radii")
    full = stats.correlations(rows, "x", "p", keys)
    full = full.withColumns({"pearson_p": stats.correlation_p("pearson_r", "n"), "spearman_p": stats.correlation_p("spearman_rho", "n")})
    without = correlation_range(rows, "x", "p", keys)
    predicted = settle(logo.leave_row_out(rows, ["x", "mainshock_mag", "log_n"], "p", keys), "predicted")
    scores = stats.errors(predicted, "actual", "predicted", [*keys, "model"]).groupBy(*keys).pivot("model", list(logo.MODELS)).agg(F.first("mae").alias("mae"), F.first("rmse").alias("rmse"), F.first("r2").alias("r2"))
    alphas = predicted.where("model = 'ridge'").groupBy(*keys).agg(F.percentile("alpha", 0.5).alias("median_alpha"))
    out = full.join(without, keys, "left").join(scores, keys, "left").join(alphas, keys, "left")
    if exact:
        out = out.join(resample.order_permutation(rows, "x", "p", keys, null=False).select(*keys, "n_orders", F.col("p_value").alias("exact_permutation_p")), keys, "left")
    return out


def subgroup_influence(sample: DataFrame, reps: int, seed: int) -> DataFrame:
    """For each mainshock left out: the fixed-effects slope, its permutation p, and errors of the three models.

    All from groups' sums less the one left out; only predictions meet rows.
    """
    own = settle(sample.groupBy(F.col("mainshock_id").alias("omitted")).agg(F.count("*").alias("own")), "sizes")
    total = own.agg(F.sum("own").alias("rows"), F.count("*").alias("groups"))  # one row
    size = own.crossJoin(F.broadcast(total)).select("omitted", (F.col("rows") - F.col("own")).alias("n"), (F.col("groups") - 1).alias("n_groups"))
    tested = resample.permutation_summary(resample.permutation_slopes_without_each(sample, reps, seed), ["omitted"])
    _, predictions = logo.compare_without_each(sample)
    scores = stats.errors(predictions, "p", "predicted", ["omitted", "model"]).groupBy("omitted").pivot("model", list(logo.MODELS)).agg(F.first("mae").alias("mae"), F.first("rmse").alias("rmse"), F.first("r2").alias("r2"))
    return size.join(tested.select("omitted", F.col("observed").alias("fe_exposure_slope"), F.col("p_value").alias("permutation_p")), "omitted").join(scores, "omitted", "left").withColumn("scope", F.lit("subgroup_fe_ml"))


def scale_influence(mainshocks: DataFrame, radii=RADII, exact: bool = True) -> DataFrame:
    """The scale study without each mainshock."""
    without = stats.without_each(mainshocks, "mainshock_id")
    return scale_study(without, radii, ["omitted"], exact).withColumn("scope", F.lit("mainshock_scale"))


def influence(sample: DataFrame, mainshocks: DataFrame, reps: int, seed: int, exact: bool = True) -> DataFrame:
    """Both scopes in one table; what a scope does not have is null."""
    return subgroup_influence(sample, reps, seed).unionByName(scale_influence(mainshocks, exact=exact), allowMissingColumns=True)


def influence_summary(found: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    return found.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg((v < 0).cast("double")).alias("share_negative"), F.avg((v > 0).cast("double")).alias("share_positive"))


def uncertainty(sample: DataFrame, draws: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, pearson_r, spearman_rho, fe_exposure_slope, <model>_mae/rmse/r2): the analysis for n picked draws of every record.

    The ridge's alphas are those of the point estimates.
    """
    chosen = settle(logo.compare(sample)[0].where("model = 'ridge'").select("test_group", "alpha"), "alphas")
    picked = resample.draw_matrix(sample.select("record_id"), draws, n, seed)
    rows = settle(sample.drop("p").join(picked, "record_id"), "picked")
    made, names = logo.features(rows)
    exposure = stats.correlations(made, "log10_pop", "p", ["rep"])
    terms, columns = stats.fe_terms(rows)
    slope = resample.slopes(stats.gram(stats.demeaned(terms, [*columns, "p"], ["rep", "mainshock_id"]), [*columns, "p"], ["rep"]), ["rep"])
    grams, shift = logo.centred_grams(made, names, "p", ["rep", "mainshock_id"])
    predictions = logo.predict(made, settle(logo.fold_models(grams, names, shift, ["rep"], chosen), "models"), names, ["rep"])
    scores = stats.errors(predictions, "p", "predicted", ["rep", "model"]).groupBy("rep").pivot("model", list(logo.MODELS)).agg(F.first("mae").alias("mae"), F.first("rmse").alias("rmse"), F.first("r2").alias("r2"))
    return exposure.select("rep", "pearson_r", "spearman_rho").join(slope.withColumnRenamed("slope", "fe_exposure_slope"), "rep").join(scores, "rep").withColumnRenamed("rep", "draw")


def uncertainty_summary(found: DataFrame) -> DataFrame:
    values = [c for c in found.columns if c != "draw"]
    long = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])).alias("m")).select("m.*")
    return intervals(long, "value", ["metric"])


def report_facts(sample: DataFrame, mainshocks: DataFrame, reps: int, seed: int) -> DataFrame:
    """One row of facts across outputs that must agree with each other."""
    fe = stats.within_fe(sample).where("term = 'log10_pop'").select(F.col("coef").alias("fe_slope"))
    tested = resample.permutation_summary(resample.permutation_slopes(sample, reps, seed), [])
    sizes = sample.agg(F.count("*").alias("n_rows"), F.count_distinct("mainshock_id").alias("n_groups"), F.count_distinct("record_id").alias("n_records"))
    shocks = mainshocks.agg(F.count_distinct("mainshock_id").alias("n_mainshocks"))
    one = sizes.crossJoin(fe).crossJoin(tested.select(F.col("observed").alias("permutation_slope"), "n_perm")).crossJoin(shocks)  # one row each
    return one.withColumn("slopes_agree", F.abs(F.col("fe_slope") - F.col("permutation_slope")) < 1e-9)




def all_facts(sample: DataFrame, fe_draws: DataFrame, tested: DataFrame, propagated: DataFrame, metrics: DataFrame, scale: DataFrame, influenced: DataFrame) -> DataFrame:
    """Every number that a report states, in one row: each from the table that also goes out.

    ``fe_draws`` (slope) are those of the cluster bootstrap, ``tested`` the
    permutation test's row, ``propagated`` uncertainty_summary, ``metrics``
    logo.metrics, ``scale`` scale_study and ``influenced`` influence. Maps are
    by kind of subgroup, metric, model, or radius; all are small tables.
    """
    propagated, metrics, scale, influenced, tested = (settle(f, "facts") for f in (propagated, metrics, scale, influenced, tested))  # each is looked at several times
    by = lambda frame, key, value, name: frame.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))
    struct = lambda frame, leave: F.struct(*[c for c in frame.columns if c not in leave])
    sizes = sample.agg(F.count("*").alias("analysis_n"), F.count_distinct("mainshock_id").alias("analysis_groups"))
    types = by(sample.groupBy("subgroup_type").agg(F.count("*").alias("n")), "subgroup_type", "n", "analysis_type_counts")
    fe = stats.within_fe(sample).where("term = 'log10_pop'").select(F.col("coef").alias("fe_slope"), F.col("r2").alias("fe_r2"), F.col("adj_r2").alias("fe_adj_r2"))
    ends = intervals(fe_draws.withColumn("_all", F.lit(0)), "slope", ["_all"]).select(F.array("p_lo", "p_hi").alias("fe_ci"), F.col("below_zero").alias("fe_negative_probability"))
    own = tested.select(F.col("observed").alias("permutation_observed"), F.col("p_value").alias("permutation_p"), F.col("n_perm").alias("permutation_n"))
    spread = by(propagated, "metric", F.struct(F.col("p_lo").alias("lo"), F.col("p_median").alias("median"), F.col("p_hi").alias("hi")), "propagation_metrics")
    below = propagated.where("metric = 'fe_exposure_slope'").select(F.col("n_draws").alias("propagation_draws"), F.col("below_zero").alias("propagation_negative_probability"))
    models = by(metrics, "model", struct(metrics, ["model"]), "ml")
    radii = by(scale, "radius_km", struct(scale, ["radius_km"]), "scale_by_radius")
    subgroups, shocks = influenced.where("scope = 'subgroup_fe_ml'"), influenced.where("scope = 'mainshock_scale'")
    left = subgroups.agg(F.count("*").alias("influence_subgroup_omissions"), F.min("fe_exposure_slope").alias("influence_slope_min"), F.max("fe_exposure_slope").alias("influence_slope_max"), F.avg((F.col("fe_exposure_slope") < 0).cast("double")).alias("influence_slope_share_negative"), F.max("permutation_p").alias("influence_permutation_p_max"))
    ranges = by(influence_summary(shocks, "pearson_r", ["radius_km"]), "radius_km", F.struct("least", "greatest", "share_negative", "share_positive"), "influence_scale_pearson")
    omitted = shocks.agg(F.count_distinct("omitted").alias("influence_scale_omissions"))
    out = sizes
    for one in (types, fe, ends, own, spread, below, models, radii, left, ranges, omitted):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out.withColumn("slopes_agree", F.abs(F.col("fe_slope") - F.col("permutation_observed")) < 1e-9)
