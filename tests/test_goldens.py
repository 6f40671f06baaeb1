"""From the published summaries our jobs must give the published results."""

import published
import pytest
from pyspark.sql import functions as F

from quakespark.jobs import studies
from quakespark.operators import logo, resample, stats


def near(a, b, digits=9):
    assert a == pytest.approx(b, abs=10**-digits)


@pytest.fixture(scope="module")
def subgroups(spark):
    return spark.createDataFrame(published.subgroups().astype({"pop_sum_subgroup": float})).withColumn("pop_sum_subgroup", F.when(~F.isnan("pop_sum_subgroup"), F.col("pop_sum_subgroup"))).cache()


@pytest.fixture(scope="module")
def sample(subgroups):
    return stats.analysis_sample(subgroups).cache()


@pytest.fixture(scope="module")
def mainshocks(spark):
    return spark.createDataFrame(published.mainshocks()).cache()


def test_analysis_sample(sample):
    assert sample.count() == 34 and sample.select("mainshock_id").distinct().count() == 6
    table = published.subgroups()
    assert {r.record_id for r in sample.collect()} == set(table[table["taken"]]["record_id"])


def test_fixed_effects(sample):
    found = {r.term: r for r in stats.within_fe(sample).collect()}
    own = found["log10_pop"]
    near(own.coef, -0.1952444057878651)
    near(own.r2, 0.70986, 5)
    near(own.adj_r2, 0.60106, 5)
    near(own.ci_lo, -0.34809, 5)
    near(own.ci_hi, -0.04240, 5)
    near(own.p_value, 0.01446, 5)
    assert (own.n, own.n_groups, own.n_parameters, own.dof) == (34, 6, 10, 24)


def test_permutation_agrees_in_size(sample):
    found = resample.permutation_summary(resample.permutation_slopes(sample, 400, 7), []).first()
    near(found.observed, -0.1952444057878651)
    assert found.n_perm == 400 and 0.001 < found.p_value < 0.03
    near(found.null_lo, -0.134, 1)
    near(found.null_hi, 0.142, 1)


def test_cluster_bootstrap_agrees_in_size(sample):
    found = resample.cluster_bootstrap_fe(sample, 300, 7).agg(F.percentile("slope", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.avg((F.col("slope") < 0).cast("double")).alias("below")).first()
    near(found.q[1], -0.213, 1)
    assert -0.6 < found.q[0] < -0.3 and -0.1 < found.q[2] < 0.05 and found.below > 0.95


def test_logo(sample):
    models, predictions = logo.compare(sample)
    found = {r.model: r for r in logo.metrics(predictions).collect()}
    for model, mae, rmse, r2 in (("mean", 0.31300, 0.36675, -0.30538), ("ols", 0.36384, 0.45138, -0.97736), ("ridge", 0.24397, 0.29148, 0.17542)):
        near(found[model].pooled_mae, mae, 5)
        near(found[model].pooled_rmse, rmse, 5)
        near(found[model].pooled_r2, r2, 5)
    near(found["ridge"].pooled_mae, 0.24396716, 8)
    alphas = [r.alpha for r in models.where("model = 'ridge'").orderBy("test_group").collect()]
    assert alphas == [10, 100, 100, 10, 100, 10]
    own = stats.class_metrics(logo.ridge_classes(predictions), "true_class", "pred_class", []).first()
    near(own.accuracy, 0.47059, 5)
    near(own.macro_f1, 0.47655, 5)


def test_scale_study(mainshocks):
    found = {r.radius_km: r for r in studies.scale_study(mainshocks).collect()}
    for radius, r, rho, p, mae in ((10, -0.11554, 0.04762, 0.78274, 0.20338), (25, -0.03223, 0.09524, 0.93690, 0.17074), (50, 0.63684, 0.61905, 0.09129, 0.16371)):
        own = found[radius]
        near(own.pearson_r, r, 5)
        near(own.spearman_rho, rho, 5)
        near(own.exact_permutation_p, p, 5)
        near(own.ridge_mae, mae, 5)
        assert own.n == 8 and own.n_orders == 40320
    near(found[50].loo_min, 0.50407, 5)
    near(found[50].loo_max, 0.79837, 5)


def test_influence(sample):
    without = stats.without_each(sample, "mainshock_id")
    slopes = stats.within_fe(without, by=["omitted"]).where("term = 'log10_pop'").agg(F.min("coef").alias("a"), F.max("coef").alias("b"), F.count("*").alias("n")).first()
    near(slopes.a, -0.29805, 5)
    near(slopes.b, -0.12313, 5)
    assert slopes.n == 6
