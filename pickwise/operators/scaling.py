"""Oracle selectors and scaling analyses (ops 107-109, 112-116).

Grids of (samples, verifiers) or (method, k) are columns of one aggregate, not
loops of jobs: e.g. the scaling matrix is one grouped aggregate with one
``max_by`` per grid cell.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import sum_cols
from pickwise.functions.joins import join_back
from pickwise.models.logistic import logistic_fit, logistic_score
from pickwise.operators.grids import Cells
from pickwise.operators.metrics import select_top1


def _first_k(df, k):
    """The first k samples of the problems that have as many."""
    enough = df.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("problem_id")
    return join_back(df.filter(F.col("sample_idx") < k), enough, "problem_id", "left_semi")


def oracle_logistic(df: DataFrame, verifiers, ks, split: float = 1.0) -> DataFrame:
    """(k, accuracy): logistic regression (balanced, C=1) fitted on the rows of the first k
    samples, selection accuracy of its top sample per problem.

    ``split`` below 1: only the first share of these rows, by problem and sample, teaches. With one label class in
    the teaching rows, a whole split gives that class's value, a share the part of all rows that have it.
    All ks are fitted together, one scan per Newton step."""
    cells = Cells(df, verifiers, ks)
    fits = cells.logistic(split)
    only = {k: f for (_, k), f in fits.items() if isinstance(f, float)}
    spark = df.sparkSession
    parts = []
    if only and split >= 1:
        parts.append(spark.createDataFrame(sorted(only.items()), "k int, accuracy double"))
    elif only:
        rows = [F.struct(F.lit(k).alias("k"), F.avg(F.when(cells.inside(k), (F.col("y") == c).cast("int"))).alias("accuracy")) for k, c in sorted(only.items())]
        parts.append(cells.rows.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("a")).select("a.*"))
    fitted = [k for k in sorted(set(ks)) if (0, k) in fits and k not in only]
    if fitted:
        parts.append(cells.accuracies({("logistic", k): cells.logistic_score(fits, k) for k in fitted}).select("k", "accuracy"))
    missing = [(k, None) for k in sorted(set(ks)) if (0, k) not in fits]
    if missing or not parts:
        parts.append(spark.createDataFrame(missing, "k int, accuracy double"))
    return reduce(DataFrame.unionByName, parts)


def oracle_logistic_per_problem(df: DataFrame, verifiers, ks) -> DataFrame:
    """(k, accuracy): one model per problem on its first k samples; all-wrong problems are
    misses, all-right problems hits, mixed problems use their own model's top sample."""
    parts = []
    for k in ks:
        d = _first_k(df, k)
        per = d.groupBy("problem_id").agg(F.min("y").alias("mn"), F.max("y").alias("mx"))
        mixed = d.join(per.filter(F.col("mn") != F.col("mx")).select("problem_id"), "problem_id", "left_semi")
        s = logistic_score(mixed, logistic_fit(mixed, verifiers, group_col="problem_id"), verifiers,
                           group_col="problem_id")
        hits = select_top1(s).select("problem_id", F.col("top1_label").alias("hit"))
        allp = per.join(hits, "problem_id", "left").select(
            F.when(F.col("mn") == 1, 1).when(F.col("mx") == 0, 0).otherwise(F.col("hit")).alias("hit"))
        parts.append(allp.agg(F.lit(k).alias("k"), F.avg("hit").alias("accuracy")))
    return reduce(DataFrame.unionByName, parts)


def label_model_at_k(votes: DataFrame, verifiers, ks, class_balance: float | None = None) -> DataFrame:
    """(k, accuracy): label model fitted (without labels) on the first k samples' votes; one scan for all ks."""
    cells = Cells(votes, verifiers, ks, votes=votes)
    v = len(verifiers)
    fits = cells.label_models([v], class_balance, continuous=False)
    return cells.accuracies({("label_model", k): cells.vote_score(fits, k, v) for k in cells.ks}).select("k", "accuracy")


def scaling_matrix(df: DataFrame, order, rs, vs) -> DataFrame:
    """(r, v, accuracy): selection accuracy of the mean of the first v verifiers of ``order``
    among the first r samples, for every grid cell, in one grouped aggregate.
    A problem takes part in the rows r that it has samples for."""
    ens = {v: sum_cols(order[:v]) / F.lit(float(v)) for v in sorted(set(vs))}
    aggs = []
    for r in sorted(set(rs)):
        for v in sorted(set(vs)):
            key = F.when(F.col("sample_idx") < r, F.struct(ens[v], -F.col("sample_idx")))
            aggs.append(F.max_by("y", key).alias(f"c{r}_{v}"))
    g = df.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), *aggs)
    acc = g.agg(*[F.avg(F.when(F.col("n") >= r, F.col(f"c{r}_{v}"))).alias(f"c{r}_{v}") for r in sorted(set(rs)) for v in sorted(set(vs))])
    cells = [F.struct(F.lit(r).alias("r"), F.lit(v).alias("v"), F.col(f"c{r}_{v}").alias("accuracy"))
             for r in rs for v in vs]
    return acc.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def verifier_scaling(df: DataFrame, order, points: int = 5) -> DataFrame:
    """(n_verifiers, accuracy) for linspace(1, V, points) verifiers taken in ``order``,
    all samples of each problem."""
    vs = [int(x) for x in np.linspace(1, len(order), points).astype(int)]
    aggs = []
    for v in sorted(set(vs)):
        aggs.append(F.max_by("y", F.struct(sum_cols(order[:v]) / F.lit(float(v)), -F.col("sample_idx"))).alias(f"c{v}"))
    g = df.groupBy("problem_id").agg(*aggs)
    acc = g.agg(*[F.avg(f"c{v}").alias(f"c{v}") for v in sorted(set(vs))])
    cells = [F.struct(F.lit(v).alias("n_verifiers"), F.col(f"c{v}").alias("accuracy")) for v in vs]
    return acc.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def verifier_order(df: DataFrame, verifiers, how: str = "best", seed: int = 42) -> list[str]:
    """Verifiers best first (by their own top-1 accuracy), worst first, or in a seeded random order."""
    from pickwise.operators.metrics import verifier_top1
    if how == "random":
        import hashlib
        return sorted(verifiers, key=lambda v: hashlib.md5(f"{seed}|{v}".encode()).hexdigest())
    acc = {r["verifier"]: r["a"] for r in verifier_top1(df, verifiers).groupBy("verifier")
           .agg(F.avg("top1_label").alias("a")).collect()}
    best = sorted(verifiers, key=lambda v: (-acc[v], verifiers.index(v)))
    return best if how == "best" else best[::-1]


METHODS = ("pass_at_k", "ensemble", "best_verifier", "majority", "logistic", "label_model", "continuous")


def scaling_curve(df: DataFrame, verifiers, ks, b: int = 5, seed: int = 42, methods=METHODS, class_balance: float | None = None,
                  answer: str = "answer", threshold: float = 0.5) -> DataFrame:
    """(method, k, mean, sd): over ``b`` draws of k samples per problem (without replacement), mean and population sd of
    pass@k, naive-ensemble, best single verifier, majority, logistic regression (fitted on the draw's
    labels), discrete and continuous label model (no labels).

    The draws are ordered once for all ks; all methods and ks read that one table."""
    cells = Cells(df, verifiers, ks, b, seed, answer=answer, threshold=threshold)
    v = len(verifiers)
    scorers: dict = {}
    if "pass_at_k" in methods:
        scorers |= dict.fromkeys([("pass_at_k", k) for k in cells.ks], F.col("y").cast("double"))
    if "ensemble" in methods:
        scorers |= dict.fromkeys([("ensemble", k) for k in cells.ks], cells.mean_score(v))
    if "best_verifier" in methods:
        for i in range(v):
            scorers |= dict.fromkeys([(f"__v{i}", k) for k in cells.ks], F.col(f"s{i}"))
    if "logistic" in methods:
        fits = cells.logistic()
        scorers |= {("logistic", k): cells.logistic_score(fits, k) for k in cells.ks}
    if "label_model" in methods or "continuous" in methods:
        models = cells.label_models([v], class_balance, "continuous" in methods)
        if "label_model" in methods:
            scorers |= {("label_model", k): cells.vote_score(models, k, v) for k in cells.ks}
        if "continuous" in methods:
            scorers |= {("continuous", k): cells.continuous_score(models, k, v) for k in cells.ks}
    found = cells.draw_accuracies(scorers, "majority" in methods)
    # the best single verifier of a draw is the best of their accuracies
    label = F.when(F.col("label").startswith("__v"), "best_verifier").otherwise(F.col("label"))
    by_draw = found.groupBy(label.alias("method"), "draw", "k").agg(F.max("accuracy").alias("accuracy"))
    return by_draw.groupBy("method", "k").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("sd"))


def scaling_heatmap(votes: DataFrame, scores: DataFrame, order, rs, vs, class_balance: float | None = None) -> DataFrame:
    """(method, r, v, accuracy) for the naive ensemble, the label model and the continuous label model (from three
    verifiers on) over a grid of first-r samples x first-v verifiers; one scan fits all cells."""
    wanted = sorted({v for v in vs if v >= 3})
    parts = [scaling_matrix(scores, order, rs, vs).select(F.lit("ensemble").alias("method"), "r", "v", "accuracy")]
    if wanted:
        cells = Cells(scores, order[:wanted[-1]], rs, votes=votes)
        fits = cells.label_models(wanted, class_balance)
        scorers = {(f"label_model|{v}", r): cells.vote_score(fits, r, v) for v in wanted for r in cells.ks}
        scorers |= {(f"continuous|{v}", r): cells.continuous_score(fits, r, v) for v in wanted for r in cells.ks}
        name = F.split("label", "[|]")
        parts.append(cells.accuracies(scorers).select(name[0].alias("method"), F.col("k").alias("r"), name[1].cast("int").alias("v"), "accuracy"))
    return reduce(DataFrame.unionByName, parts)


def power_law_fit(curves: DataFrame, series: str = "series", x: str = "x", y: str = "y") -> DataFrame:
    """Fit y = a * x^b + c per series (<= a few dozen points each) by damped Gauss-Newton in
    ``applyInPandas``; returns (series, a, b, c, r2)."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        xs = pdf[x].to_numpy(dtype=float)
        ys = pdf[y].to_numpy(dtype=float)
        theta = np.array([ys.max() - ys.min() if ys.max() > ys.min() else 1.0, 0.5, ys.min()])
        lam = 1e-3
        for _ in range(200):
            a, b, c = theta
            xb = np.power(xs, b)
            pred = a * xb + c
            r = ys - pred
            jac = np.stack([xb, a * xb * np.log(np.maximum(xs, 1e-12)), np.ones_like(xs)], axis=1)
            h = jac.T @ jac + lam * np.eye(3)
            step = np.linalg.solve(h, jac.T @ r)
            new = theta + step
            if np.sum((ys - (new[0] * np.power(xs, new[1]) + new[2])) ** 2) < np.sum(r ** 2):
                theta, lam = new, lam * 0.5
            else:
                lam *= 10
            if np.max(np.abs(step)) < 1e-12:
                break
        a, b, c = theta
        pred = a * np.power(xs, b) + c
        ss_res = float(np.sum((ys - pred) ** 2))
        ss_tot = float(np.sum((ys - ys.mean()) ** 2))
        r2 = 1 - ss_res / ss_tot if ss_tot > 0 else float("nan")
        return pd.DataFrame({series: [pdf[series].iloc[0]], "a": [a], "b": [b], "c": [c], "r2": [r2]})

    st = dict(curves.dtypes)[series]
    return curves.groupBy(series).applyInPandas(fit, f"{series} {st}, a double, b double, c double, r2 double")
