"""Samples, correlations and regressions from sums that Spark aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.labels import range_of
from quakespark.functions.students_t import quantile, two_sided_p
from quakespark.operators.ordering import average_ranks
from quakespark.sources.adapters import finite
from quakespark.sources.tables import settle

FALLBACKS = ("all_depth", "all_relaxed")
NEEDED = ("mainshock_id", "subgroup_type", "subgroup", "n_events", "p")
EXPOSURES = ("pop_sum_subgroup", "pop_sum_50km")


def analysis_sample(subgroups: DataFrame, radius_km: float = 400.0, min_events: int = 25) -> DataFrame:
    """Subgroups fit for inference: no aggregates, no ring over the full radius, enough events, people and a finite p."""
    missing = sorted(set(NEEDED) - set(subgroups.columns)) + ([] if set(EXPOSURES) & set(subgroups.columns) else [EXPOSURES[0]])
    if missing:
        raise ValueError(f"Missing analysis columns: {missing}")
    low, high = range_of(F.lower("subgroup"))
    full = (F.col("subgroup_type") == "ring") & (low == 0) & (F.abs(high - radius_km) <= 1e-9 * F.greatest(high, F.lit(radius_km)))
    number = lambda c: finite(F.col(c).try_cast("double"))
    good = ~F.col("subgroup").isin(*FALLBACKS) & ~F.coalesce(full, F.lit(False)) & (number("n_events") >= min_events) & (number(exposure_column(subgroups)) > 0) & number("p").isNotNull()
    return subgroups.where(good).withColumn("analysis_included", F.lit(True))


def merge_with_exposure(fits: DataFrame, exposure: DataFrame, left: str, right: str) -> DataFrame:
    """Fits with their exposure (or none); columns of the same name in both get the suffix _exp."""
    renamed = exposure.withColumnRenamed(right, left)
    renamed = renamed.withColumnsRenamed({c: f"{c}_exp" for c in renamed.columns if c in fits.columns and c != left})
    return fits.join(renamed, left, "left")


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where either is constant or there are fewer than two rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    moves = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(moves, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))))


def correlations(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """n, pearson_r, spearman_rho, slope and intercept of y on x, by group; rows with a null or infinite value are left out."""
    kept = rows.withColumns({"_x": finite(F.col(x).cast("double")), "_y": finite(F.col(y).cast("double"))}).where("_x is not null and _y is not null")
    ranked = average_ranks(kept.select(*by, "_x", "_y"), {"_x": "_rx", "_y": "_ry"}, by)
    slope = F.when(F.min("_x") < F.max("_x"), F.try_divide(F.covar_pop("_x", "_y"), F.var_pop("_x")))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson("_x", "_y").alias("pearson_r"), pearson("_rx", "_ry").alias("spearman_rho"), slope.alias("slope"), (F.avg("_y") - slope * F.avg("_x")).alias("intercept"))


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p of a correlation r of n rows under independence; null where there is no r or n < 3."""

    def one(r, n):
        if pd.isna(r) or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else two_sided_p(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)

    def many(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")

    many.__annotations__ = {"r": pd.Series, "n": pd.Series, "return": pd.Series}
    return F.pandas_udf(many, "double")(r, n)


# ---- sums of products


def gram(rows: DataFrame, columns: list[str], by: list[str], weight: str | None = None) -> DataFrame:
    """(by, n, sums, products): sums of the columns and of their products, the upper triangle row by row."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    cols = [F.col(c).cast("double") for c in columns]
    sums = F.array(*[F.sum(w * c) for c in cols])
    products = F.array(*[F.sum(w * a * b) for i, a in enumerate(cols) for b in cols[i:]])
    return rows.groupBy(*by).agg(F.sum(w).alias("n"), sums.alias("sums"), products.alias("products"))


def unpack(n: float, sums, products) -> np.ndarray:
    """The symmetric matrix of products of (1, columns)."""
    k = len(sums)
    out = np.zeros((k + 1, k + 1))
    out[0, 0] = n
    out[0, 1:] = sums
    out[1:, 1:][np.triu_indices(k)] = products
    return out + np.triu(out, 1).T


def independent(matrix: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns of a design that are not combinations of earlier ones, from its matrix of products."""
    kept: list[int] = []
    for j in range(len(matrix)):
        rest = matrix[j, j]
        if kept:
            own = matrix[np.ix_(kept, [j])][:, 0]
            rest = matrix[j, j] - own @ np.linalg.lstsq(matrix[np.ix_(kept, kept)], own, rcond=None)[0]
        if rest > tolerance * max(matrix[j, j], 1e-300):
            kept.append(j)
    return kept


def ols_rows(matrix: np.ndarray, names: list[str]) -> list[tuple]:
    """(term, coef, se, t, p_value, ci_lo, ci_hi, n, dof, r2, adj_r2) from products of (1, names..., outcome)."""
    x, xy, yy, n = matrix[:-1, :-1], matrix[:-1, -1], matrix[-1, -1], matrix[0, 0]
    inverse = np.linalg.pinv(x, rcond=1e-13, hermitian=True)
    beta = inverse @ xy
    rest = max(float(yy - 2 * beta @ xy + beta @ x @ beta), 0.0)
    dof = max(n - len(x), 1)
    se = np.sqrt(np.maximum(np.diag(inverse) * rest / dof, 0))
    total = yy - matrix[0, -1] ** 2 / n
    r2 = 1 - rest / total if total > 1e-15 else None
    adjusted = None if r2 is None else 1 - (1 - r2) * (n - 1) / dof
    critical = quantile(0.975, dof)
    out = []
    for name, b, s in zip(["const", *names], beta, se, strict=True):
        t = b / max(s, 1e-12)
        out.append((name, float(b), float(s), float(t), two_sided_p(float(t), dof), float(b - critical * s), float(b + critical * s), int(round(n)), int(round(dof)), r2, adjusted))
    return out


OLS = "term string, coef double, se double, t double, p_value double, ci_lo double, ci_hi double, n long, dof long, r2 double, adj_r2 double"


def ols(rows: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Least squares of y on a constant and xs, by group. Rows are read once, for sums; columns are centred first.

    Centring (on means over all rows) keeps the sums small; the constant is
    moved back afterwards.
    """
    by = by or []
    complete = rows.dropna(subset=[y, *xs])
    means = complete.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [*xs, y]]).first()
    shift = [float(means[c] or 0.0) for c in [*xs, y]]
    sums = gram(complete.select(*by, *[(F.col(c).cast("double") - m).alias(c) for c, m in zip([*xs, y], shift, strict=True)]), [*xs, y], by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.to_dict("records"):
                n, sums_, products = r["n"], r["sums"], r["products"]
                if n and n > 0:
                    back = np.eye(len(shift) + 1)
                    back[1:, 0] = shift
                    found += [(*[r[b] for b in by], *x) for x in ols_rows(back @ unpack(n, sums_, products) @ back.T, xs)]
            yield pd.DataFrame(found, columns=[*by, *[c.split()[0] for c in OLS.split(", ")]])

    kinds = dict(rows.dtypes)
    return sums.mapInPandas(solve, ", ".join([*[f"{b} {kinds[b]}" for b in by], OLS]))


def exposure_column(frame: DataFrame) -> str:
    """The subgroups' own population where a table has it, else that within 50 km."""
    return EXPOSURES[0] if EXPOSURES[0] in frame.columns else EXPOSURES[1]


def with_terms(sample: DataFrame) -> DataFrame:
    """Adds log10_pop (null where there are no people) and log_n_events."""
    return sample.withColumns({"log10_pop": F.log10(exposure_column(sample)), "log_n_events": F.log(F.greatest(F.col("n_events").cast("double"), F.lit(1.0)))})


def controlled(rows: DataFrame, outcome: str = "p", effects: bool = False) -> DataFrame:
    """Least squares of the outcome on log10(exposure, 1 at least), magnitude and log(n), with effects of the mainshocks if wanted.

    The effects are indicators fe_* of all mainshocks but the first.
    """
    made = rows.withColumns({"log10_pop": F.log10(F.greatest(finite(F.col(exposure_column(rows)).cast("double")), F.lit(1.0))), "log_n_events": F.log(F.greatest(F.col("n_events").cast("double"), F.lit(1.0)))})
    made = made.withColumn(outcome, finite(F.col(outcome).cast("double"))).dropna(subset=[outcome, "log10_pop", "mainshock_mag", "log_n_events"])
    names = ["log10_pop", "mainshock_mag", "log_n_events"]
    return absorbed(made, outcome, names, "mainshock_id") if effects else ols(made, outcome, names)


def absorbed(rows: DataFrame, y: str, xs: list[str], group: str) -> DataFrame:
    """Least squares of y on a constant, xs and an indicator fe_<g> of each group but the first (as strings), in the form of ``ols``.

    The indicators are no columns: coefficients come from deviations from
    group means, an effect and its error from its group's means. Where xs do
    not vary within groups there are many solutions; that of the least squares
    of all coefficients is taken, as a pseudo-inverse of the whole design does.
    A group is a row of a table; only k x k sums are collected.
    """
    k, nothing = len(xs), "term string, coef double, se double, t double, p_value double, ci_lo double, ci_hi double, n long, dof long, r2 double, adj_r2 double"
    kept = rows.select(F.col(group).cast("string").alias("g"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([*xs, y])]).dropna(subset=[f"v{i}" for i in range(k + 1)])
    columns = [f"v{i}" for i in range(k + 1)]
    whole = kept.agg(F.count("*").alias("n"), (F.var_pop(f"v{k}") * F.count("*")).alias("total"), *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in columns]).first()
    if not whole["n"]:
        return rows.sparkSession.createDataFrame([], nothing)
    means = settle(kept.groupBy("g").agg(F.count("*").cast("double").alias("m"), *[F.avg(c).alias(c) for c in columns]), "group_means")
    inner = gram(demeaned(kept, columns, ["g"]), columns, []).first()
    m = unpack(inner["n"], inner["sums"], inner["products"])[1:, 1:]
    scale = np.array([max(whole[c], 1e-300) for c in columns[:k]])
    values, vectors = np.linalg.eigh(m[:k, :k] / np.outer(scale, scale) / whole["n"])
    varies = values > 1e-12
    null = np.linalg.qr(vectors[:, ~varies] / scale[:, None])[0] if (~varies).any() else np.zeros((k, 0))
    inverse = (vectors[:, varies] / values[varies]) @ vectors[:, varies].T / np.outer(scale, scale) / whole["n"]
    across = np.eye(k) - null @ null.T
    inverse = across @ inverse @ across  # of all solutions the one without a part that does not vary
    b0 = inverse @ m[:k, k]
    first = means.orderBy("g").limit(1).first()
    w1, y1, n1 = np.array([first[c] for c in columns[:k]]), first[f"v{k}"], first["m"]
    others = means.where(F.col("g") != first["g"])
    d = [F.col(c) - float(w) for c, w in zip(columns, [*w1, y1], strict=True)]
    own = d[k] - sum((d[i] * float(b0[i]) for i in range(k)), F.lit(0.0))  # an effect before what does not vary is dealt with
    sums = lambda f: F.array(*[F.coalesce(F.sum(f(i, j)), F.lit(0.0)) for i in range(k) for j in range(k)])
    total = others.agg(F.count("*").alias("groups"), sums(lambda i, j: d[i] * d[j]).alias("dd"), sums(lambda i, j: d[i] * d[j] / F.col("m")).alias("ddm"), sums(lambda i, j: d[i] * F.col(columns[j])).alias("dw"), F.array(*[F.coalesce(F.sum(d[i] * own), F.lit(0.0)) for i in range(k)]).alias("da"), F.array(*[F.coalesce(F.sum(d[i]), F.lit(0.0)) for i in range(k)]).alias("d")).first()
    dd, ddm, dw = (np.array(total[c]).reshape(k, k) for c in ("dd", "ddm", "dw"))
    a1 = y1 - w1 @ b0
    b = np.linalg.inv(np.eye(null.shape[1]) + null.T @ (np.outer(w1, w1) + dd) @ null) @ null.T
    c1 = b @ (w1 - np.array(total["d"]))
    q = b @ dw + np.outer(c1, w1)
    spread = b @ ddm @ b.T + np.outer(c1, c1) / n1
    beta = b0 + null @ (b @ (w1 * a1 + np.array(total["da"])))
    carried = np.eye(k) - null @ q
    inside, between = carried @ inverse @ carried.T, null @ spread @ null.T
    size, parameters = int(whole["n"]), 1 + k + int(total["groups"])
    rest, dof = max(float(m[k, k] - b0 @ m[:k, k]), 0.0), max(size - parameters, 1)
    noise = rest / dof
    r2 = 1 - rest / whole["total"] if whole["total"] > 1e-15 else None
    adjusted = None if r2 is None else 1 - (1 - r2) * (size - 1) / dof
    const_var = w1 @ (inside + between) @ w1 + 1 / n1 - 2 * w1 @ null @ c1 / n1
    few = [("const", float(y1 - w1 @ beta), float(const_var))] + [(name, float(beta[i]), float((inside + between)[i, i])) for i, name in enumerate(xs)]
    coef = d[k] - sum((d[i] * float(beta[i]) for i in range(k)), F.lit(0.0))
    both, turned = inside + between, null @ b
    var = sum((d[i] * d[j] * float(both[i, j]) for i in range(k) for j in range(k)), F.lit(0.0)) + 1 / F.col("m") + 1 / n1
    var = var - 2 * sum((d[i] * (d[j] * float(turned[i, j]) / F.col("m")) for i in range(k) for j in range(k)), F.lit(0.0)) + 2 * sum((d[i] * float((null @ c1)[i] / n1) for i in range(k)), F.lit(0.0))
    effects = others.select(F.concat(F.lit("fe_"), F.col("g")).alias("term"), coef.alias("coef"), var.alias("var"))
    every = rows.sparkSession.createDataFrame(few, "term string, coef double, var double").unionByName(effects)
    se, critical = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)) * noise), float(quantile(0.975, dof))
    tested = every.select("term", "coef", se.alias("se")).withColumn("t", F.col("coef") / F.greatest("se", F.lit(1e-12)))
    return tested.select("term", "coef", "se", "t", t_p("t", dof).alias("p_value"), (F.col("coef") - critical * F.col("se")).alias("ci_lo"), (F.col("coef") + critical * F.col("se")).alias("ci_hi"), F.lit(size).cast("long").alias("n"), F.lit(dof).cast("long").alias("dof"), F.lit(r2).cast("double").alias("r2"), F.lit(adjusted).cast("double").alias("adj_r2"))


def t_p(t: str, dof: int) -> Column:
    """Two-sided p of a t statistic."""

    def many(t: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(float(x), dof) for x in t], dtype="float64")

    many.__annotations__ = {"t": pd.Series, "return": pd.Series}
    return F.pandas_udf(many, "double")(t)


def type_levels(sample: DataFrame) -> list[str]:
    return sorted(r[0] for r in sample.select("subgroup_type").distinct().collect())  # a handful of kinds


def fe_terms(sample: DataFrame, levels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The sample with the columns of the fixed-effects model, and their names: exposure, log n, types but the first."""
    levels = type_levels(sample) if levels is None else levels
    named = {f"type_{v}": (F.col("subgroup_type") == v).cast("double") for v in levels[1:]}
    return with_terms(sample).withColumns(named) if named else with_terms(sample), ["log10_pop", "log_n_events", *named]


def demeaned(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns less their mean in the group."""
    return rows.withColumns({c: F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(Window.partitionBy(*by)) for c in columns})


def fe_fit(matrix: np.ndarray, names: list[str], groups: int, total: float) -> dict:
    """The fixed-effects model from products of demeaned (terms..., outcome); ``total``: the outcome's squares about its mean.

    Terms that add nothing to earlier ones are left out; exposure comes first.
    """
    n, inner, own, yy = matrix[0, 0], matrix[1:-1, 1:-1], matrix[1:-1, -1], matrix[-1, -1]
    kept = independent(inner)
    inverse = np.linalg.pinv(inner[np.ix_(kept, kept)], rcond=1e-13, hermitian=True)
    beta = inverse @ own[kept]
    rest = max(float(yy - beta @ own[kept]), 0.0)
    k = len(kept) + groups
    dof = int(round(n)) - k
    r2 = 1 - rest / total if total > 1e-15 else None
    se = np.sqrt(np.maximum(np.diag(inverse) * rest / dof, 0)) if dof > 0 else np.full(len(kept), np.nan)
    return {"n": int(round(n)), "n_parameters": k, "dof": dof, "r2": r2, "adj_r2": None if r2 is None or dof <= 0 else 1 - (1 - r2) * (n - 1) / dof, "terms": [names[i] for i in kept], "coef": beta, "se": se}


FE = "term string, coef double, se double, p_value double, ci_lo double, ci_hi double, n long, n_groups long, n_parameters long, dof long, r2 double, adj_r2 double"


def within_fe(sample: DataFrame, outcome: str = "p", by: list[str] | None = None) -> DataFrame:
    """p ~ log10(exposure) + log(n) + type + fixed effects of the mainshock, by ``by`` (for example an omitted mainshock)."""
    by = by or []
    rows, names = fe_terms(sample.dropna(subset=[outcome, exposure_column(sample), "n_events", "mainshock_id", "subgroup_type"]))
    columns = [*names, outcome]
    sums = gram(demeaned(rows, columns, [*by, "mainshock_id"]), columns, by)
    shape = rows.groupBy(*by).agg(F.count_distinct("mainshock_id").alias("groups"), (F.var_pop(outcome) * F.count(outcome)).alias("total"))
    both = sums.join(shape, by) if by else sums.crossJoin(shape)  # one row each

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                if not r.n or r.n < 5 or r.groups < 2:
                    continue
                fit = fe_fit(unpack(r.n, r.sums, r.products), names, int(r.groups), r.total)
                for name, b, s in zip(fit["terms"], fit["coef"], fit["se"], strict=True):
                    known = fit["dof"] > 0 and s > 0
                    half = quantile(0.975, fit["dof"]) * s if known else None
                    found.append((*[getattr(r, x) for x in by], name, float(b), float(s) if known else None, two_sided_p(float(b / s), fit["dof"]) if known else None, b - half if known else None, b + half if known else None, fit["n"], int(r.groups), fit["n_parameters"], fit["dof"], fit["r2"], fit["adj_r2"]))
            yield pd.DataFrame(found, columns=[*by, *[c.split()[0] for c in FE.split(", ")]])

    kinds = dict(sample.dtypes)
    return both.mapInPandas(solve, ", ".join([*[f"{b} {kinds[b]}" for b in by], FE]))


def without_each(rows: DataFrame, group: str, name: str = "omitted") -> DataFrame:
    """Each row once for every group that may be left out: all but its own. The groups are a small level set."""
    levels = sorted(r[0] for r in rows.select(F.col(group).cast("string")).distinct().collect())
    others = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<string>"), lambda g: g != F.col(group))
    return rows.withColumn(name, F.explode(others))


# ---- prediction errors and classes


def errors(rows: DataFrame, true: str, predicted: str, by: list[str]) -> DataFrame:
    """mae, rmse, r2 (null where the true values hardly vary) by group, over finite pairs."""
    kept = rows.withColumns({"_t": finite(F.col(true).cast("double")), "_p": finite(F.col(predicted).cast("double"))}).where("_t is not null and _p is not null")
    e = F.col("_t") - F.col("_p")
    total = F.var_pop("_t") * F.count("*")
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(total > 1e-12, 1 - F.try_divide(F.sum(e * e), total)).alias("r2"), F.stddev_pop("_t").alias("target_sd"))


def class_metrics(rows: DataFrame, true: str, predicted: str, by: list[str], classes: int = 3) -> DataFrame:
    """accuracy and macro_f1 by group; 0 where a class has neither."""
    f1 = []
    for k in range(classes):
        hit = F.sum(((F.col(true) == k) & (F.col(predicted) == k)).cast("double"))
        both = F.sum((F.col(true) == k).cast("double")) + F.sum((F.col(predicted) == k).cast("double"))
        f1.append(F.coalesce(F.try_divide(2 * hit, both), F.lit(0.0)))
    return rows.groupBy(*by).agg(F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"), (sum(f1[1:], f1[0]) / classes).alias("macro_f1"))


def confusion(rows: DataFrame, true: str, predicted: str, by: list[str], classes: int = 3) -> DataFrame:
    counts = rows.groupBy(*by, F.col(true).alias("true_class")).pivot(predicted, list(range(classes))).count()
    return counts.select(*by, "true_class", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"pred_{k}") for k in range(classes)])


def histogram(rows: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """Counts in ``bins`` equal widths from the least to the greatest value, the last bin closed; empty bins are left out."""
    ends = Window.partitionBy(*by)
    low, high = F.min(value).over(ends), F.max(value).over(ends)
    place = F.least(F.floor(F.coalesce(F.try_divide((F.col(value) - low) * bins, high - low), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"))
