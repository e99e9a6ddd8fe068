"""Fallback paths, answers that must not be missing, early stopping, bucketed iterations, damped fits."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwise.functions.buckets import Bucketed
from pickwise.models.logistic import logistic_fit
from pickwise.operators import scores as S
from pickwise.operators.distill import best_epoch
from pickwise.operators.metrics import majority_at_k
from pickwise.sources.tables import load_responses


@pytest.mark.parametrize("inside", ["", "data", "train/part"])
def test_responses_are_found_at_the_path_or_below_it(spark, tmp_path, inside):
    df = spark.createDataFrame([(1, "q", ["a"], [0.5])], "problem_id long, problem string, samples array<string>, rm_scores array<double>")
    df.write.parquet(str(tmp_path / "t" / inside) if inside else str(tmp_path / "t"))
    got = load_responses(spark, str(tmp_path / "t"))
    assert got.columns == ["problem_id", "instruction", "samples", "rm_scores"] and got.count() == 1


def test_no_responses_anywhere_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_responses(spark, str(tmp_path / "nothing"))


def test_missing_answers_are_skipped_or_an_error(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 0, "NO_ANSWER"), (1, 2, 0, "b")], "problem_id long, sample_idx int, y int, answer string")
    assert [(r["k"], r["majority_at_k"]) for r in majority_at_k(df, [1, 3]).orderBy("k").collect()] == [(1, 1.0), (3, 1.0)]
    assert majority_at_k(df, [1], no_answer="error").first()["majority_at_k"] == 1.0       # the first sample has one
    with pytest.raises(Exception, match="without an answer"):
        majority_at_k(df, [3], no_answer="error").collect()


@pytest.mark.parametrize("delta", [0.0, 0.1])
def test_best_epoch_equals_a_walk(spark, delta):
    rnd = random.Random(7)
    runs = {r: [round(rnd.random(), 2) for _ in range(rnd.randrange(1, 12))] for r in range(40)}
    df = spark.createDataFrame([(r, e, x) for r, xs in runs.items() for e, x in enumerate(xs)], "run_id long, epoch long, loss double").repartition(4)
    got = {r["run_id"]: tuple(r)[1:] for r in best_epoch(df, 3, delta).collect()}
    for r, xs in runs.items():
        best, at, streak, stop, seen = float("inf"), None, 0, None, 0
        for e, x in enumerate(xs):
            seen += 1
            best, at, streak = (x, e, 0) if x < best - delta else (best, at, streak + 1)
            if streak >= 3:
                stop = e
                break
        assert got[r] == (at, best, stop, seen)


def _moved(node, name, exchanged=False):
    """Is there an exchange between the scan of ``name`` and the first sum or join above it?"""
    kind = node.nodeName()
    if kind.startswith("Scan") and name in node.toString():
        return exchanged
    if kind == "AdaptiveSparkPlan":
        return _moved(node.initialPlan(), name, False)
    above = True if "Exchange" in kind else False if "Aggregate" in kind or "Join" in kind else exchanged
    children = node.children()
    return any(_moved(children.apply(i), name, above) for i in range(children.size()))


def test_rows_of_an_iteration_stay_where_they_lie(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(0 if i % 3 == 0 else int(i % 50), float(v)) for i, v in enumerate(rng.normal(size=3_000))], "g long, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Bucketed(df, "g", part_rows=100) as laid:
            means = df.groupBy("g").agg(F.avg("x").alias("m"))
            out = laid.sums(laid.beside(means), {"n": F.lit(1), "s": (F.col("x") - F.col("m")) * 2})
            assert not _moved(out._jdf.queryExecution().executedPlan(), laid.name)
            got = {r["g"]: (r["n"], r["s"]) for r in out.collect()}
            assert sum(n for n, _ in got.values()) == 3_000 and all(abs(s) < 1e-9 for _, s in got.values())
            # a third of the rows in one key: many parts, none much above the bound
            assert laid.rows.where("g = 0").groupBy("__part").count().agg(F.max("count")).first()[0] < 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not spark.catalog.tableExists(laid.name)


def test_logistic_by_group_with_a_hot_group(spark, monkeypatch):
    from pickwise.functions import buckets

    monkeypatch.setattr(buckets, "PART_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(int(0 if rng.random() < 0.4 else rng.integers(1, 5)), float(x)) for x in rng.normal(size=800)]
    rows = [(g, x, int(rng.random() < 1 / (1 + np.exp(-(x * (g + 1) - 0.3))))) for g, x in rows]
    got = {r["g"]: (r["b0"], r["b1"]) for r in logistic_fit(spark.createDataFrame(rows, "g long, x double, y int"), ["x"], "g").collect()}
    for g in range(5):
        x, y = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        d, b = np.c_[np.ones(len(x)), x], np.array(got[g])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        assert np.abs(d.T @ (w * (1 / (1 + np.exp(-d @ b)) - y)) + np.array([0, b[1]])).max() < 1e-6


def test_sigmoid_calibration_converges_on_large_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(10, 1, 400)
    df = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)], "problem_id long, sample_idx int, v double")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = np.array([r["v"] for r in S.calibrate_sigmoid(df, ["v"]).orderBy("problem_id").collect()])
    above = x > np.median(x)
    assert (np.argsort(np.argsort(got, kind="stable")) >= 0).all() and got[above].min() > 0.5 > got[~above].max()


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(5)
    rows = []
    for p in range(80):
        for i in range(4):
            y = int(rng.random() < 0.15 + 0.7 * (p % 2))
            rows.append((p, i, y, f"a{y}{i % 2}", *[float(np.clip(0.5 + (y - 0.5) * 0.7 + rng.normal(0, 0.25), 0, 1)) for _ in range(3)]))
    return spark.createDataFrame(rows, "problem_id long, sample_idx int, y int, answer string, a double, b double, c double").cache()


@pytest.mark.parametrize("config", [{"model": "triplet"}, {"model": "mixture", "calibrate": "isotonic"}, {"model_class": "cluster", "clusters": "kmeans"},
                                    {"model_class": "cluster", "clusters": "map"}])
def test_runs_reach_every_model_and_cluster(spark, graded, tmp_path, config):
    import json

    from pickwise.plans.selection import RunConfig, run

    if config.get("clusters") == "map":
        path = tmp_path / "map.json"
        path.write_text("\n".join(json.dumps({str(p): p % 2}) for p in range(80)))
        config = config | {"cluster_path": str(path)}
    results, summary, _ = run(graded, ["a", "b", "c"], RunConfig(**config))
    first = graded.where("sample_idx = 0").agg(F.avg("y")).first()[0]
    got = [r for r in summary.collect() if r["set"] == "train"][0]
    assert results.where("set = 'train'").count() == 80 and got["n_problems"] == 80 and got["select_acc"] > first


def test_runs_refuse_models_that_would_be_fitted_one_by_one(graded):
    from pickwise.plans.selection import RunConfig, run

    with pytest.raises(ValueError):
        run(graded, ["a"], RunConfig(model="label_model", model_class="per_problem"))
