"""Regressions, prediction and studies against plain numpy on small tables."""

import collections
import hashlib
import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest

from quakespark.jobs import studies
from quakespark.operators import logo, resample, stats
from quakespark.sources import sinks

SCHEMA = "record_id string, mainshock_id string, subgroup_type string, subgroup string, mainshock_mag double, n_events int, pop_sum_subgroup double, p double"
KINDS = [("depth", "0-10km"), ("depth", "10-20km"), ("region", "East_of_ms"), ("region", "West_of_ms"), ("ring", "0-50km"), ("ring", "50-400km")]


def rows_of(groups=5, seed=3):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        for kind, label in KINDS[: 6 - g % 2]:
            pop = 10 ** r.uniform(4, 6)
            out.append((f"m{g}|{kind}|{label}", f"m{g}", kind, label, 6.0 + 0.3 * g, r.randint(25, 200), pop, 0.9 - 0.15 * math.log10(pop) + 0.1 * g + r.gauss(0, 0.1)))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).cache()


# ---- plain rules


def fe_design(rows, pops=None):
    """Constant, exposure, log n, kinds and mainshocks; columns that add nothing are dropped."""
    types, groups = sorted({x[2] for x in rows}), sorted({x[1] for x in rows})
    columns = [[1.0] * len(rows), [math.log10(v) for v in (pops or [x[6] for x in rows])], [math.log(x[5]) for x in rows]]
    names = ["const", "log10_pop", "log_n_events", *[f"type_{t}" for t in types[1:]]]
    columns += [[float(x[2] == t) for x in rows] for t in types[1:]] + [[float(x[1] == g) for x in rows] for g in groups[1:]]
    kept, names = [], names + [f"group_{g}" for g in groups[1:]]
    for k in range(len(columns)):
        if np.linalg.matrix_rank(np.array([columns[i] for i in [*kept, k]])) > len(kept):
            kept.append(k)
    return np.array([columns[k] for k in kept]).T, [names[k] for k in kept]


def fe_slope(rows, pops=None):
    x, names = fe_design(rows, pops)
    return float(np.linalg.lstsq(x, np.array([r[7] for r in rows]), rcond=None)[0][names.index("log10_pop")])


def plain_features(rows):
    types, regions = sorted({x[2] for x in rows}), sorted({x[3] for x in rows if x[2] == "region"})
    middle = lambda s: sum(map(float, s[:-2].split("-"))) / 2
    made = [[math.log10(x[6]), x[4], math.log(x[5]), middle(x[3]) if x[2] == "ring" else 0.0, middle(x[3]) if x[2] == "depth" else 0.0, *[float(x[2] == t) for t in types], *[float(x[3] == v) for v in regions]] for x in rows]
    names = ["log10_pop", "mainshock_mag", "log_n_events", "ring_mid_km", "depth_mid_km", *[f"type_{t}" for t in types], *[f"region_{v}" for v in regions]]
    return np.array(made), names


def plain_ridge(x, y, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-12, 1.0, scale)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - mean @ beta, beta


def plain_alpha(x, y, groups, alphas, square=False):
    losses = []
    for alpha in alphas:
        own = []
        for g in sorted(set(groups)):
            test = groups == g
            a, b = plain_ridge(x[~test], y[~test], alpha)
            mse = np.mean((y[test] - a - x[test] @ b) ** 2)
            own.append(mse if square else math.sqrt(mse))
        losses.append(np.mean(own))
    return alphas[int(np.argmin(losses))]


def plain_logo(x, y, groups, alphas=logo.ALPHAS, square=False, default=None, chosen=None):
    """{model: predictions}, {group: alpha}, {group: ridge coefficients}"""
    out, picked, beta = {m: np.zeros(len(y)) for m in logo.MODELS}, {}, {}
    for g in sorted(set(groups)):
        test = groups == g
        tx, ty, tg = x[~test], y[~test], groups[~test]
        alpha = chosen[g] if chosen else default if default is not None and len(set(tg)) < 4 else plain_alpha(tx, ty, tg, alphas, square)
        one = np.column_stack([np.ones(len(tx)), tx])
        ols = np.linalg.pinv(one, rcond=1e-9) @ ty
        a, b = plain_ridge(tx, ty, alpha)
        out["mean"][test], out["ols"][test], out["ridge"][test] = ty.mean(), ols[0] + x[test] @ ols[1:], a + x[test] @ b
        picked[g], beta[g] = alpha, b
    return out, picked, beta


def plain_errors(y, p):
    e = y - p
    return np.abs(e).mean(), math.sqrt((e**2).mean()), 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()


def columns(rows):
    return np.array([x[7] for x in rows]), np.array([x[1] for x in rows])


# ---- tests


def test_fixed_effects_against_explicit_design(sample):
    rows = rows_of()
    x, names = fe_design(rows)
    y = np.array([r[7] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    dof = len(y) - x.shape[1]
    rest = ((y - x @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rest / dof)
    got = {r.term: r for r in stats.within_fe(sample).collect()}
    assert set(got) == {"log10_pop", "log_n_events", "type_region", "type_ring"}
    for term, own in got.items():
        k = names.index(term)
        assert (own.coef, own.se) == pytest.approx((beta[k], se[k]), abs=1e-8) and (own.n, own.n_groups, own.n_parameters, own.dof) == (len(y), 5, x.shape[1], dof)
        r2 = 1 - rest / ((y - y.mean()) ** 2).sum()
        assert (own.r2, own.adj_r2) == pytest.approx((r2, 1 - (1 - r2) * (len(y) - 1) / dof), abs=1e-8)
        assert own.ci_lo < own.coef < own.ci_hi and 0 <= own.p_value <= 1 and (own.p_value < 0.05) == (own.ci_lo * own.ci_hi > 0)


@pytest.mark.parametrize("effects", [False, True])
def test_controlled_regression(sample, effects):
    rows = rows_of()
    groups = sorted({x[1] for x in rows})
    x = np.array([[1.0, math.log10(max(r[6], 1)), r[4], math.log(r[5]), *([float(r[1] == g) for g in groups[1:]] if effects else [])] for r in rows])
    y = np.array([r[7] for r in rows])
    beta = np.linalg.pinv(x) @ y
    got = {r.term: r for r in stats.controlled(sample, effects=effects).collect()}
    assert got["log10_pop"].coef == pytest.approx(beta[1], abs=1e-7) and got["log_n_events"].coef == pytest.approx(beta[3], abs=1e-7)
    assert got["log10_pop"].r2 == pytest.approx(1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-7)
    if not effects:
        rest = ((y - x @ beta) ** 2).sum() / (len(y) - 4)
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rest)
        assert {t: got[t].se for t in ("const", "log10_pop", "mainshock_mag", "log_n_events")} == pytest.approx(dict(zip(("const", "log10_pop", "mainshock_mag", "log_n_events"), se, strict=True)), abs=1e-7)
    else:
        assert {f"fe_{g}" for g in groups[1:]} <= set(got)


def test_exposure_falls_back_to_the_buffer(spark):
    rows = [(f"m{i % 3}", 6.0 + i % 4, 25 + i, 10.0 ** (i % 5), 0.5 + 0.1 * (i % 7)) for i in range(20)]
    frame = spark.createDataFrame(rows, "mainshock_id string, mainshock_mag double, n_events int, pop_sum_50km double, p double")
    same = frame.withColumnRenamed("pop_sum_50km", "pop_sum_subgroup")
    a, b = ({r.term: r.coef for r in stats.controlled(f).collect()} for f in (frame, same))
    assert stats.exposure_column(frame) == "pop_sum_50km" and a == pytest.approx(b)


def test_prediction_against_plain_folds(sample):
    rows = rows_of()
    x, names = plain_features(rows)
    y, groups = columns(rows)
    want, alphas, _ = plain_logo(x, y, groups)
    models, predictions = logo.compare(sample)
    assert {r.test_group: r.alpha for r in models.where("model = 'ridge'").collect()} == alphas
    place = {x[0]: k for k, x in enumerate(rows)}
    got = predictions.collect()
    assert len(got) == 3 * len(rows)
    for r in got:
        assert r.predicted == pytest.approx(want[r.model][place[r.record_id]], abs=1e-6), (r.model, r.record_id)
    for r in logo.metrics(predictions).collect():
        assert (r.pooled_mae, r.pooled_rmse, r.pooled_r2) == pytest.approx(plain_errors(y, want[r.model]), abs=1e-6)
        folds = [plain_errors(y[groups == g], want[r.model][groups == g]) for g in set(groups)]
        assert (r.macro_mae, r.macro_rmse, r.macro_r2) == pytest.approx(tuple(np.mean(folds, axis=0)), abs=1e-6)
    levels = {}
    for g in set(groups):
        q1, q2 = np.percentile(y[groups != g], [33, 66])
        for k in np.flatnonzero(groups == g):
            levels[rows[k][0]] = (int(y[k] >= q1) + int(y[k] >= q2), int(want["ridge"][k] >= q1) + int(want["ridge"][k] >= q2))
    classes = logo.ridge_classes(predictions)
    assert {r.record_id: (r.true_class, r.pred_class) for r in classes.collect()} == levels
    table = collections.Counter(levels.values())
    assert {(r.true_class, k): r[f"pred_{k}"] for r in stats.confusion(classes, "true_class", "pred_class", []).collect() for k in range(3) if r[f"pred_{k}"]} == dict(table)


def test_importance_against_plain_permutation(sample):
    rows = rows_of()
    x, names = plain_features(rows)
    y, groups = columns(rows)
    want, _, beta = plain_logo(x, y, groups)
    base = math.sqrt(((y - want["ridge"]) ** 2).mean())
    got = {r.feature: r.delta_rmse for r in logo.importance(sample, 3, 7).collect()}
    assert set(got) == set(names)
    for i, name in enumerate(names):
        level = all(len(set(x[groups == g, i])) == 1 for g in set(groups))
        losses = []
        for rep in (1, 2, 3):
            unit = groups if level else np.array([r[0] for r in rows])
            new = {}
            for pool in [""] if level else sorted(set(groups)):
                own = sorted({u for u, g in zip(unit, groups, strict=True) if level or g == pool})
                value = {u: x[k, i] for k, u in enumerate(unit)}
                order = sorted(own, key=lambda u: (hashlib.md5(f"7|{i}|{rep}|{u}".encode()).hexdigest(), u))  # noqa: B023
                new |= {u: value[v] for u, v in zip(own, order, strict=True)}
            moved = want["ridge"] + np.array([beta[g][i] for g in groups]) * (np.array([new[u] for u in unit]) - x[:, i])
            losses.append(math.sqrt(((y - moved) ** 2).mean()))
        assert got[name] == pytest.approx(np.mean(losses) - base, abs=1e-6), name


def permuted(rows, rep, seed=7):
    """The exposures dealt to the rows of each mainshock in the order of hashes."""
    pops = [x[6] for x in rows]
    if not rep:
        return pops
    out = list(pops)
    for g in {x[1] for x in rows}:
        own = sorted((k for k, x in enumerate(rows) if x[1] == g), key=lambda k: rows[k][0])
        order = sorted(own, key=lambda k: (hashlib.md5(f"{seed}|{rep}|{rows[k][0]}".encode()).hexdigest(), rows[k][0]))
        for to, k in zip(own, order, strict=True):
            out[to] = pops[k]
    return out


def test_permutation_test_refits_each_order(sample):
    rows = rows_of()
    want = [fe_slope(rows, permuted(rows, rep)) for rep in range(21)]
    got = {r.rep: r.slope for r in resample.permutation_slopes(sample, 20, 7).collect()}
    assert [got[k] for k in range(21)] == pytest.approx(want, abs=1e-7)
    p = resample.permutation_summary(resample.permutation_slopes(sample, 20, 7), []).first()
    assert p.n_perm == 20 and p.p_value == pytest.approx((sum(abs(s) >= abs(want[0]) for s in want[1:]) + 1) / 21)


def test_cluster_bootstrap_relabels_drawn_groups(sample):
    rows = rows_of()
    grouped = {g: [x for x in rows if x[1] == g] for g in {x[1] for x in rows}}
    draws = resample.cluster_draws(sample.selectExpr("mainshock_id as group"), 6, 7).collect()
    got = {r.rep: r.slope for r in resample.cluster_bootstrap_fe(sample, 6, 7).collect()}
    for rep in range(1, 7):
        own = [(*x[:1], f"{d.group}#{k}", *x[2:]) for d in draws if d.rep == rep for k in range(d.times) for x in grouped[d.group]]
        assert sum(d.times for d in draws if d.rep == rep) == 5 and got[rep] == pytest.approx(fe_slope(own), abs=1e-7)


def test_influence_of_each_mainshock(sample):
    rows = rows_of()
    got = {r.omitted: r for r in studies.subgroup_influence(sample, 20, 7).collect()}
    assert set(got) == {f"m{g}" for g in range(5)}
    for g, own in got.items():
        rest = [x for x in rows if x[1] != g]
        slopes = [fe_slope(rest, permuted(rest, rep)) for rep in range(21)]
        assert (own.n, own.n_groups, own.scope) == (len(rest), 4, "subgroup_fe_ml")
        assert own.fe_exposure_slope == pytest.approx(slopes[0], abs=1e-7)
        assert own.permutation_p == pytest.approx((sum(abs(s) >= abs(slopes[0]) for s in slopes[1:]) + 1) / 21)
        x, _ = plain_features(rest)
        y, groups = columns(rest)
        want, _, _ = plain_logo(x, y, groups)
        for model in logo.MODELS:
            assert (own[f"{model}_mae"], own[f"{model}_rmse"], own[f"{model}_r2"]) == pytest.approx(plain_errors(y, want[model]), abs=1e-6)


def test_uncertainty_repeats_the_analysis_for_each_draw(spark, sample):
    rows = rows_of()
    r = random.Random(4)
    draws = spark.createDataFrame([(x[0], k, x[7] + r.gauss(0, 0.1)) for x in rows for k in range(4)], "record_id string, draw int, p_boot double")
    picked = collections.defaultdict(dict)
    for d in resample.draw_matrix(sample.select("record_id"), draws, 3, 7).collect():
        picked[d.rep][d.record_id] = d.p
    x, _ = plain_features(rows)
    y0, groups = columns(rows)
    _, alphas, _ = plain_logo(x, y0, groups)
    found = studies.uncertainty(sample, draws, 3, 7)
    got = {d.draw: d for d in found.collect()}
    assert set(got) == {1, 2, 3}
    for rep, own in got.items():
        y = np.array([picked[rep][v[0]] for v in rows])
        again = [(*v[:7], p) for v, p in zip(rows, y, strict=True)]
        assert own.pearson_r == pytest.approx(np.corrcoef(x[:, 0], y)[0, 1], abs=1e-8) and own.fe_exposure_slope == pytest.approx(fe_slope(again), abs=1e-7)
        want, _, _ = plain_logo(x, y, groups, chosen=alphas)
        for model in logo.MODELS:
            assert (own[f"{model}_mae"], own[f"{model}_rmse"], own[f"{model}_r2"]) == pytest.approx(plain_errors(y, want[model]), abs=1e-6)
    ends = {s.metric: s for s in studies.uncertainty_summary(found).collect()}
    slopes = [got[k].fe_exposure_slope for k in got]
    assert ends["fe_exposure_slope"].n_draws == 3 and (ends["fe_exposure_slope"].p_lo, ends["fe_exposure_slope"].p_median) == pytest.approx(tuple(np.percentile(slopes, [2.5, 50])))


def shocks(n=6):
    r = random.Random(11)
    return [(f"g{i}", 0.4 + 0.08 * i + r.gauss(0, 0.1), 6.0 + 0.1 * (i % 3), 30.0 + 5 * i, *[10 ** (4 + k * 0.5 + r.uniform(0, 1)) for k in range(3)]) for i in range(n)]


MAINSHOCKS = "mainshock_id string, p double, mainshock_mag double, n_events double, pop_sum_10km double, pop_sum_25km double, pop_sum_50km double"


def check_scale(own, rows, k):
    x = np.array([math.log10(v[4 + k]) for v in rows])
    y = np.array([v[1] for v in rows])
    slope = lambda a, b: ((a - a.mean()) @ b) / ((a - a.mean()) @ (a - a.mean()))
    assert own.n == len(rows) and own.pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1]) and own.slope == pytest.approx(slope(x, y))
    rank = lambda a: np.argsort(np.argsort(a))
    assert own.spearman_rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    hits = [abs(slope(x, y[list(o)])) >= abs(slope(x, y)) - 1e-12 for o in itertools.permutations(range(len(y)))]
    assert own.n_orders == len(hits) and own.exact_permutation_p == pytest.approx(np.mean(hits))
    without = [np.corrcoef(np.delete(x, i), np.delete(y, i))[0, 1] for i in range(len(y))]
    assert (own.loo_min, own.loo_max) == pytest.approx((min(without), max(without)))
    design = np.column_stack([x, [v[2] for v in rows], [math.log(v[3]) for v in rows]])
    want, alphas, _ = plain_logo(design, y, np.array([v[0] for v in rows]), logo.SCALE_ALPHAS, True, 1.0)
    assert own.median_alpha == pytest.approx(np.median(list(alphas.values())))
    for model in logo.MODELS:
        assert (own[f"{model}_mae"], own[f"{model}_rmse"], own[f"{model}_r2"]) == pytest.approx(plain_errors(y, want[model]), abs=1e-6)


def test_scale_study_and_its_influence(spark):
    rows = shocks()
    frame = spark.createDataFrame(rows, MAINSHOCKS)
    got = {r.radius_km: r for r in studies.scale_study(frame).collect()}
    assert set(got) == {10, 25, 50}
    for k, radius in enumerate((10, 25, 50)):
        check_scale(got[radius], rows, k)
    less = {(r.omitted, r.radius_km): r for r in studies.scale_influence(frame).collect()}
    assert len(less) == 18 and {r.scope for r in less.values()} == {"mainshock_scale"}
    for k, radius in enumerate((10, 25, 50)):
        check_scale(less["g2", radius], [v for v in rows if v[0] != "g2"], k)


def test_permutation_of_all_orders_keeps_its_null(spark):
    rows = [(float(i), float((i * 3) % 7)) for i in range(7)]
    frame = spark.createDataFrame([("a", *v) for v in rows], "g string, x double, y double")
    full, short = (resample.exact_permutation(frame, "x", "y", ["g"], null).first() for null in (True, False))
    assert (full.n_orders, full.p_value, full.observed) == (short.n_orders, short.p_value, short.observed) and full.n_orders == 5040
    x, y = (np.array(v) for v in zip(*rows, strict=True))
    slopes = [((x - x.mean()) @ y[list(o)]) / ((x - x.mean()) @ (x - x.mean())) for o in itertools.permutations(range(7))]
    assert (full.null_lo, full.null_hi) == pytest.approx(tuple(np.percentile(slopes, [2.5, 97.5])))


def test_mainshock_lists_and_nested_fits(spark, tmp_path):
    many = [{"usgs_id": "a", "time_utc": "2020-01-02T03:04:05.678Z", "lat": 1.0, "lon": 2.0, "depth_km": None, "mag": 6.1, "place": "x"}, {"usgs_id": "b", "time_utc": "2021-01-01T00:00:00+00:00", "lat": 3.0, "lon": 4.0, "depth_km": 10.0, "mag": 5.5, "place": None}]
    (tmp_path / "list.json").write_text(json.dumps(many, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(many[0]))
    got = {r.usgs_id: r for r in sinks.read_mainshocks(spark, str(tmp_path / "list.json")).collect()}
    assert set(got) == {"a", "b"} and got["a"].time_us == 1577934245678000 and got["a"].depth_km is None and got["b"].mag == 5.5
    assert sinks.read_mainshocks(spark, str(tmp_path / "one.json")).first() == got["a"]
    fits = spark.createDataFrame([("m|mainshock|all", "m", "mainshock", "all", 0.9), ("m|ring|0-50km", "m", "ring", "0-50km", float("nan"))], "record_id string, mainshock_id string, subgroup_type string, subgroup string, p double")
    sinks.write_json(sinks.nested_fits(fits, {"Mc": 1.5}), f"{tmp_path}/fits")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/fits").collect()]
    assert {x["section"] for x in lines} == {"by_mainshock", "by_subgroup"} and all(x["baseline"] == {"Mc": 1.5} for x in lines)
    back = sinks.read_fits(spark, f"{tmp_path}/fits", "by_mainshock", "record_id string, p double").collect()
    assert [(r.mainshock_id, r.record_id, r.p) for r in back] == [("m", "m|mainshock|all", 0.9)]
    sinks.write_ordered(fits, [fits.p.desc()], f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == 2


def test_correlation_range_is_that_of_each_row_left_out(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"key": np.repeat(["a", "b", "two", "flat"], [30, 9, 2, 6]), "x": rng.normal(size=47), "y": rng.normal(size=47)})
    frame.loc[frame["key"] == "flat", "x"] = [1.0, 1.0, 1.0, 1.0, 1.0, 4.0]
    got = {r.key: (r.loo_min, r.loo_max) for r in studies.correlation_range(spark.createDataFrame(frame), "x", "y", ["key"]).collect()}
    for key, own in frame.groupby("key"):
        left = [own.drop(i) for i in own.index]
        r = [np.corrcoef(f["x"], f["y"])[0, 1] for f in left if len(f) > 1 and f["x"].nunique() > 1]
        assert got[key] == ((None, None) if not r else pytest.approx((min(r), max(r)), abs=1e-9))
