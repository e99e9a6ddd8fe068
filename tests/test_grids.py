"""Cells of a grid fitted together against one fit per cell."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pickwise.models.label_model import label_model_fit, label_model_score
from pickwise.models.logistic import logistic_fit, logistic_score
from pickwise.models.moments import triplet_fit, triplet_score
from pickwise.operators import scaling as SC
from pickwise.operators.metrics import select_top1
from pickwise.operators.sampling import bootstrap_samples

V = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def scores(spark):
    """Problems of one to five samples, four noisy scorers with abstentions."""
    rng = np.random.default_rng(8)
    pid = np.repeat(np.arange(150), rng.integers(1, 6, 150))
    y = (rng.random(len(pid)) < 0.45).astype(int)
    pdf = pd.DataFrame({"problem_id": pid, "sample_idx": pd.Series(pid).groupby(pid).cumcount(), "y": y, "answer": np.where(y == 1, "right", [f"w{i % 3}" for i in range(len(y))])})
    for i, v in enumerate(V):
        pdf[v] = np.clip(0.5 + (y - 0.5) * (0.9 - 0.15 * i) + rng.normal(0, 0.4, len(y)), 0, 1).round(3)
    return spark.createDataFrame(pdf, "problem_id long, sample_idx int, y int, answer string, a double, b double, c double, d double").repartition(5).cache()


def votes_of(df):
    return df.select("problem_id", "sample_idx", "y", *[F.when(F.col(v) >= 0.5, 1.0).otherwise(0.0).alias(v) for v in V])


def first(df, k):
    enough = df.groupBy("problem_id").count().where(F.col("count") >= k).select("problem_id")
    return df.where(F.col("sample_idx") < k).join(enough, "problem_id")


def top(scored):
    return select_top1(scored).agg(F.avg("top1_label")).first()[0]


def test_logistic_cells_equal_single_fits(scores):
    got = {r["k"]: r["accuracy"] for r in SC.oracle_logistic(scores, V, [1, 3, 5]).collect()}
    for k in (1, 3, 5):
        d = first(scores, k)
        assert got[k] == pytest.approx(top(logistic_score(d, logistic_fit(d, V), V)), abs=1e-12)


def test_a_share_of_the_rows_teaches(spark, scores):
    got = {r["k"]: r["accuracy"] for r in SC.oracle_logistic(scores, V, [2, 4], split=0.37).collect()}
    for k in (2, 4):
        d = first(scores, k).toPandas().sort_values(["problem_id", "sample_idx"]).reset_index(drop=True)
        teach = spark.createDataFrame(d[:max(1, int(len(d) * 0.37))])
        assert got[k] == pytest.approx(top(logistic_score(spark.createDataFrame(d), logistic_fit(teach, V), V)), abs=1e-12)
    ones = scores.withColumn("y", (F.col("problem_id") < 60).cast("int"))
    share = first(ones, 2).agg(F.avg("y")).first()[0]
    assert [(r["k"], r["accuracy"]) for r in SC.oracle_logistic(ones, V, [2], split=0.1).collect()] == [(2, pytest.approx(share))]


def test_label_model_cells_equal_single_fits(scores):
    votes = votes_of(scores)
    got = {r["k"]: r["accuracy"] for r in SC.label_model_at_k(votes, V, [2, 5]).collect()}
    for k in (2, 5):
        d = first(votes, k)
        assert got[k] == pytest.approx(top(label_model_score(d, label_model_fit(d, V), V)), abs=1e-12)


def test_heatmap_equals_single_fits(scores):
    votes = votes_of(scores)
    got = {(r["method"], r["r"], r["v"]): r["accuracy"] for r in SC.scaling_heatmap(votes, scores, V, [2, 4], [1, 3, 4], 0.45).collect()}
    assert {m for m, _, _ in got} == {"ensemble", "label_model", "continuous"} and ("label_model", 2, 1) not in got
    for r in (2, 4):
        for v in (3, 4):
            d, s = first(votes, r), first(scores, r)
            assert got["label_model", r, v] == pytest.approx(top(label_model_score(d, label_model_fit(d, V[:v], 0.45), V[:v])), abs=1e-12)
            assert got["continuous", r, v] == pytest.approx(top(triplet_score(s, triplet_fit(s, V[:v]), V[:v])), abs=1e-12)


def test_curve_of_seven_methods_over_draws(scores):
    got = {(r["method"], r["k"]): (r["mean"], r["sd"]) for r in SC.scaling_curve(scores, V, [1, 3], 2, 42, class_balance=0.45).collect()}
    assert {m for m, _ in got} == set(SC.METHODS)
    for k in (1, 3):
        draws = bootstrap_samples(scores, k, 2, 42).cache()
        want = {"logistic": [], "label_model": [], "continuous": [], "pass_at_k": []}
        for d in (0, 1):
            own = draws.where(F.col("draw") == d).drop("draw", "slot")
            votes = votes_of(own)
            want["logistic"].append(top(logistic_score(own, logistic_fit(own, V), V)))
            want["label_model"].append(top(label_model_score(votes, label_model_fit(votes, V, 0.45), V)))
            want["continuous"].append(top(triplet_score(own, triplet_fit(own, V), V)))
            want["pass_at_k"].append(own.groupBy("problem_id").agg(F.max("y").alias("y")).agg(F.avg("y")).first()[0])
        for m, values in want.items():
            assert got[m, k] == (pytest.approx(np.mean(values), abs=1e-12), pytest.approx(np.std(values), abs=1e-12)), (m, k)


ODD = [(1, 0, 1, "a", 0.5), (1, 1, 0, "b", None), (1, 2, 0, "b", float("nan")), (1, 3, None, "b", 0.2), (2, 0, 0, "NO_ANSWER", None), (2, 1, 1, None, None), (2, 2, 1, None, -0.0), (2, 3, 0, "a", 0.0),
       (3, 0, None, "c", 0.9), (3, 1, None, "c", 0.9), (4, 0, 1, "a", 0.1), (5, 0, 0, "NO_ANSWER", 0.3), (5, 1, 1, "NO_ANSWER", 0.3), (6, None, 1, "a", 0.4), (6, 1, 0, "a", 0.4), (None, 0, 1, "a", 0.1)]


def test_a_sample_is_one_row_of_all_draws(spark):
    """Copies of the samples for every draw went through two sorts and two aggregates."""
    from pickwise.operators.grids import Cells

    d = spark.createDataFrame(ODD, "problem_id long, sample_idx int, y int, answer string, u double")
    cells = Cells(d, ["u"], [1, 2, 4], 3, 42, answer="answer")
    assert cells.rows.count() == 15
    for draw in range(3):       # the places of a problem's samples in a draw are those of the bootstrap's
        slots = {(r["problem_id"], r["sample_idx"]): r[f"slot{draw}"] for r in cells.rows.collect()}
        want = {(r["problem_id"], r["sample_idx"]): r["slot"] - 1 for r in bootstrap_samples(d.where("problem_id is not null"), 1, 3, 42).where(f"draw = {draw}").collect()}
        assert want and all(slots[key] == at for key, at in want.items())


@pytest.mark.parametrize("most", [1024, 2])
def test_draw_accuracies_of_odd_rows(spark, monkeypatch, most):
    """Nulls, NaN and zeros of either sign rank as in the aggregate; with ``most`` 2 the larger problems are drawn from in pieces."""
    from pickwise.functions import whole
    from pickwise.operators.grids import Cells

    monkeypatch.setattr(whole, "GROUP_ROWS", most)
    d = spark.createDataFrame(ODD, "problem_id long, sample_idx int, y int, answer string, u double")
    cells = Cells(d, ["u"], [1, 2, 4], 1, 42, answer="answer")
    scorers = {("u", k): F.col("s0") for k in (1, 2, 4)} | {("w", k): [F.col("w0")] for k in (2, 4)}
    got = {(r["label"], r["k"]): r["accuracy"] for r in cells.draw_accuracies(scorers, majority=True).collect()}
    assert {key: x for key, x in got.items() if key[0] != "majority"} == {(r["label"], r["k"]): r["accuracy"] for r in cells.accuracies(scorers).collect()}
    rows = cells.rows.collect()
    for k in (1, 2, 4):
        right = []
        for p in range(1, 7):
            own = [r for r in rows if r["problem_id"] == p and r["slot0"] < k and r["n"] >= k and r["answer"] != "NO_ANSWER"]
            groups = {a: [r for r in own if r["answer"] == a] for a in {r["answer"] for r in own}}
            if groups:
                top = max(groups.values(), key=lambda g: (len(g), -min(float("inf") if r["sample_idx"] is None else r["sample_idx"] for r in g)))
                labels = [r["y"] for r in top if r["y"] is not None]
                right += [sum(labels) > len(top) / 2] if labels else []
        assert got["majority", k] == (pytest.approx(np.mean(right)) if right else None)
