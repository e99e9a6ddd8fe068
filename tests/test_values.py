"""Value checks of the registered queries that SQL cannot state, against NumPy on the same rows (sf0.001)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwise.plans.catalog import diagnostics, fitted, verifiers as vcat
from pickwise.plans.registry import all_queries
from pickwise.plans.selection import weak_votes
from pickwise.sources.fixtures import f1, f3, f4

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()


def rows(spark, key):
    return QUERIES[key].build(spark, SF).collect()


def matrix(df, columns):
    return np.array([[np.nan if x is None else x for x in r] for r in df.select(*columns).collect()], dtype=float)


def covariance(x):
    return np.cov(x, rowvar=False, ddof=1)


def test_precision_matrix_is_the_inverse_covariance(spark):
    got = rows(spark, "precision_matrix")
    names = diagnostics.DV
    n = len(names)
    cov = np.array([[next(r["cov"] for r in got if (r["vi"], r["vj"]) == (a, b)) for b in names] for a in names])
    precision = np.array([[next(r["precision"] for r in got if (r["vi"], r["vj"]) == (a, b)) for b in names] for a in names])
    assert np.allclose(cov @ precision, np.eye(n), atol=1e-6)


def test_dependency_pairs_and_independent_subset(spark):
    names = list(vcat.IND)
    x = matrix(weak_votes(f1(spark, SF), names), [*names, "y"])
    strength = np.abs(np.linalg.inv(covariance(x) + 1e-6 * np.eye(len(names) + 1))[:-1, :-1])
    pairs = sorted(((strength[i, j], names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names))), reverse=True)
    got = rows(spark, "dependency_pairs")
    assert len(got) == int(0.3 * len(pairs))
    for r, (s, a, b) in zip(got, pairs):
        assert (r["vi"], r["vj"]) == (a, b) and r["abs_precision"] == pytest.approx(s, rel=0.02)
    best = rows(spark, "independent_subset")
    assert len(best) == 1 and set(best[0]["subset"].split(",")) <= set(names) and best[0]["sparsity"] > 0


def test_logistic_coefficients_are_stationary(spark):
    names = fitted.LR
    x = matrix(fitted._lr_data(spark, SF), ["y", *names])
    x = x[~np.isnan(x).any(axis=1)]
    y, d = x[:, 0], np.hstack([np.ones((len(x), 1)), x[:, 1:]])
    r = rows(spark, "logistic")[0]
    beta = np.array([r[f"b{i}"] for i in range(d.shape[1])])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-d @ beta))
    grad = d.T @ (w * (p - y)) + np.r_[0, beta[1:]]
    assert np.abs(grad).max() < 0.05 * np.sqrt(len(y))


def test_density_clusters_equal_brute_force(spark):
    pts = sorted((r["problem_id"], np.array(r["embedding"], dtype=float)) for r in f4(spark, SF).select("problem_id", "embedding").collect())
    ids, x = [i for i, _ in pts], np.array([v / np.linalg.norm(v) for _, v in pts])
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.5
    core = near.sum(1) >= 5
    label = np.full(len(ids), -1)
    cluster = 0
    for i in range(len(ids)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = cluster
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j] & core & (label < 0)):
                    label[k] = cluster
                    todo.append(k)
            cluster += 1
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    got = {r["problem_id"]: r["cluster_id"] for r in rows(spark, "cluster_density")}
    assert got == dict(zip(ids, label.tolist()))


def test_kmeans_assigns_the_nearest_centre(spark):
    e = {r["problem_id"]: np.array(r["embedding"], dtype=float) for r in f4(spark, SF).select("problem_id", "embedding").collect()}
    got = [r for r in rows(spark, "cluster_kmeans") if r["set"] == "train"]
    x, c = np.array([e[r["problem_id"]] for r in got]), np.array([r["cluster_id"] for r in got])
    centres = np.array([x[c == k].mean(0) if (c == k).any() else np.full(x.shape[1], np.inf) for k in range(10)])
    assert (np.linalg.norm(x[:, None] - centres[None], axis=2).argmin(1) == c).mean() > 0.9


@pytest.mark.parametrize("key,groups", [("cluster_gmm", 4), ("cluster_hierarchical", 10), ("cluster_spectral", 10)])
def test_fitted_clusters_cover_every_problem_once(spark, key, groups):
    got = rows(spark, key)
    assert len({r["problem_id"] for r in got}) == len(got) == f4(spark, SF).count()
    assert {r["cluster_id"] for r in got} <= set(range(groups)) and len({r["cluster_id"] for r in got}) > 1


@pytest.mark.parametrize("key,column", [("quantile_norm", "rm_q"), ("quantile_norm", "rm_price"), ("quantile_norm_normal", "rm_q"), ("calibrate_sigmoid", "rm_price")])
def test_maps_of_scores_are_monotone_into_the_unit_interval(spark, key, column):
    before = {(r["problem_id"], r["sample_idx"]): r[column] for r in f1(spark, SF).select("problem_id", "sample_idx", column).collect()}
    pairs = sorted((before[r["problem_id"], r["sample_idx"]], r[column]) for r in rows(spark, key) if r[column] is not None and before[r["problem_id"], r["sample_idx"]] is not None)
    x, y = np.array(pairs).T
    assert len(x) and y.min() >= 0 and y.max() <= 1
    if key == "quantile_norm":
        assert (np.diff(y) >= -1e-6).all()
        assert np.abs(y - np.searchsorted(np.sort(x), x, "right") / len(x)).mean() < 0.02  # near the empirical distribution


def test_quantiles_of_each_problem_are_its_own_ranks(spark):
    before: dict = {}
    for r in f1(spark, SF).select("problem_id", "sample_idx", "rm_price").collect():
        before.setdefault(r["problem_id"], {})[r["sample_idx"]] = r["rm_price"]
    checked = 0
    for r in rows(spark, "quantile_norm_per_problem"):
        own = before[r["problem_id"]]
        values = sorted(set(own.values()))
        if len(values) == len(own) > 2 and None not in values:  # distinct scores: evenly spaced levels
            assert r["rm_price"] == pytest.approx(values.index(own[r["sample_idx"]]) / (len(values) - 1), abs=1e-5)
            checked += 1
    assert checked > 100


def test_isotonic_calibration_is_monotone_within_a_problem(spark):
    before = {(r["problem_id"], r["sample_idx"]): r["rm_disc"] for r in f1(spark, SF).select("problem_id", "sample_idx", "rm_disc").collect()}
    by: dict = {}
    for r in rows(spark, "calibrate_isotonic"):
        if r["rm_disc"] is not None:
            by.setdefault(r["problem_id"], []).append((before[r["problem_id"], r["sample_idx"]], r["rm_disc"]))
    assert by
    for pairs in by.values():
        y = [b for _, b in sorted(pairs)]
        assert all(b >= a - 1e-6 for a, b in zip(y, y[1:])) and min(y) >= 0 and max(y) <= 1


def test_score_many_row_by_row(spark):
    told = {(r["problem_id"], r["sample_idx"]): (r["instruction"], r["response"]) for r in f3(spark, SF).collect()}
    for r in rows(spark, "score_many"):
        asked, said = told[r["problem_id"], r["sample_idx"]]
        assert r["len_ratio"] == pytest.approx(len(said) / (1 + len(asked)) if said is not None and asked is not None else 0.0, abs=1e-6)
        assert (r["fragile_prm"] is None) == (said is not None and "?" in said) and r["fragile"] == (r["fragile_prm"] or 0.0)


def test_label_model_rates_are_probabilities(spark):
    for r in rows(spark, "label_model"):
        whole = (r["p_s0_y0"] + r["p_s1_y0"], r["p_s0_y1"] + r["p_s1_y1"])  # the rest are abstentions
        assert all(0 < w <= 1.001 for w in whole) and (r["verifier"] == "j_abstain" or min(whole) > 0.999)
        assert r["p_s1_y1"] > r["p_s1_y0"]  # a judge better than chance


@pytest.mark.parametrize("key", ["logistic_select", "label_model_select", "gaussian_em", "mixture_logistic", "selection_run_class_balance", "selection_run_winsorized_labels"])
def test_selection_reports_add_up(spark, key):
    """Counts add up, and a fitted choice is never worse than the first sample."""
    first = f1(spark, SF).where("sample_idx = 0").agg(F.avg("y")).first()[0]
    for r in rows(spark, key):
        assert r["select_tp"] + r["select_tn"] + r["select_fp"] + r["select_fn"] == r["n_problems"] and r["select_fp"] == 0
        assert r["select_acc"] == pytest.approx(r["select_tp"] / r["n_problems"]) and r["select_acc"] > first


@pytest.mark.parametrize("key", ["oracle_logistic", "oracle_logistic_split", "oracle_logistic_per_problem", "label_model_at_k"])
def test_accuracy_at_k_lies_between_mean_and_coverage(spark, key):
    d = f1(spark, SF)
    for r in rows(spark, key):
        k = r["k"]
        own = d.where(F.col("sample_idx") < k).groupBy("problem_id").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.max("y").alias("h")).where(F.col("n") >= k)
        mean, most = own.agg(F.avg("m"), F.avg("h")).first()
        assert mean - 1e-6 <= r["accuracy"] <= most + 1e-6


def test_per_problem_runs_route_every_test_problem(spark):
    got = rows(spark, "selection_run_per_problem")
    trained = {r["model_id"] for r in got if r["set"] == "train"}
    test = [r for r in got if r["set"] == "test"]
    assert test and all(r["model_id"] in trained and r["distance"] >= 0 for r in test)
    assert all(r["model_id"] == r["problem_id"] and r["distance"] == 0 for r in got if r["set"] == "train")


def test_fitted_curves_lie_between_mean_and_coverage(spark):
    d = f1(spark, SF)
    got = rows(spark, "scaling_curve_fits")
    assert {(r["method"], r["k"]) for r in got} == {(m, k) for m in ("logistic", "label_model", "continuous") for k in (1, 2, 4)}
    for r in got:
        own = d.groupBy("problem_id").agg(F.count("*").alias("n"), F.max("y").alias("h")).where(F.col("n") >= r["k"])
        assert 0 < r["mean"] <= own.agg(F.avg("h")).first()[0] and r["sd"] >= 0


def test_power_law_follows_its_curve(spark):
    for r in rows(spark, "power_law_fit"):
        assert 0.95 < r["r2"] <= 1
        values = [r["a"] * k ** r["b"] + r["c"] for k in range(1, 9)]
        assert all(b > a for a, b in zip(values, values[1:])) and 0 < values[0] and values[-1] < 1.02


def test_mixup_stays_between_its_ends(spark):
    for r in rows(spark, "augment_mixup"):
        assert 0 <= r["lam"] <= 1 and 0 <= r["y_mix"] <= 1


def test_heatmap_and_distilled_scorer(spark):
    heat = rows(spark, "scaling_heatmap")
    assert len({(r["method"], r["r"], r["v"]) for r in heat}) == len(heat) and all(0 < r["accuracy"] < 1 for r in heat)
    got = rows(spark, "distilled_scorer")
    assert got and all(r["prediction"] is not None and -0.5 <= r["prediction"] <= 1.5 for r in got)  # a linear scorer
    known = [r for r in got if r["label"] is not None]
    y, p = np.array([r["label"] for r in known]), np.array([r["prediction"] for r in known])
    assert ((p - y) ** 2).mean() <= ((y - y.mean()) ** 2).mean() + 1e-6


def test_distilled_scorer_report_adds_up(spark):
    r = rows(spark, "distilled_scorer_report")[0]
    assert r["n"] > 0 and 0 <= r["accuracy"] <= 1 and r["mae"] ** 2 <= r["mse"] + 1e-12 and abs(r["bias"]) <= r["mae"] + 1e-12


def test_mixup_weights_follow_the_beta_law_and_mix_vectors(spark):
    from pickwise.operators.sampling import _beta_from_uniform, augment_mixup

    u = np.random.default_rng(1).random(40_000)
    for alpha in (0.2, 1.0, 2.0):
        x = _beta_from_uniform(u, alpha)
        assert abs(x.mean() - 0.5) < 0.01 and abs(x.var() - 1 / (4 * (2 * alpha + 1))) < 0.005
    assert (_beta_from_uniform(u[:10], 0.2) == _beta_from_uniform(u, 0.2)[:10]).all()
    df = spark.createDataFrame([(i, 0, i % 2, float(i), [float(i), -float(i)]) for i in range(20)], "problem_id long, sample_idx int, y int, v double, e array<double>")
    for r in augment_mixup(df, ["v"], vectors=["e"]).collect():
        assert r["e"][0] == pytest.approx(r["v"]) and r["e"][1] == pytest.approx(-r["v"])


def test_by_difficulty_covers_the_split(spark):
    got = rows(spark, "selection_run_by_difficulty")
    assert sum(r["train_problems"] or 0 for r in got) + sum(r["test_problems"] or 0 for r in got) == f1(spark, SF).select("problem_id").distinct().count()


def test_single_models_per_problem_need_both_labels(spark):
    d = f1(spark, SF).groupBy("problem_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo <> hi").count()
    assert len(rows(spark, "logistic_per_problem")) == d
