"""Selection runs that fit, search and score once what several sets or groups share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwise.models import label_model as LM
from pickwise.operators import neighbors as NB
from pickwise.plans import selection as SEL

V = ["a", "b", "c"]


def _scores(spark, n=60, samples=5):
    rng = np.random.default_rng(11)
    y = (rng.random((n, samples)) < np.linspace(0.1, 0.9, n)[:, None]).astype(int)
    rows = []
    for p in range(n):
        for s in range(samples):
            votes = [float(y[p, s] if rng.random() < q else 1 - y[p, s]) for q in (0.9, 0.8, 0.7)]
            rows.append((p, s, int(y[p, s]), *votes))
    return spark.createDataFrame(rows, "problem_id long, sample_idx int, y int, a double, b double, c double")


@pytest.mark.parametrize("balance", [None, 0.4])
def test_fits_of_all_groups_equal_single_fits(spark, balance):
    df = _scores(spark).withColumn("g", F.col("problem_id") % 3)
    got = LM.label_model_fits(df, V, balance, "g")
    assert sorted(got) == [0, 1, 2]
    for g, params in got.items():
        want = LM.label_model_fit(df.where(F.col("g") == g), V, balance).toPandas()
        have = params.toPandas()
        assert have["verifier"].tolist() == V
        assert np.allclose(have.drop(columns="verifier"), want.drop(columns="verifier"), atol=1e-9)


def test_a_run_on_all_problems_fits_once_and_searches_nothing(spark, monkeypatch):
    """Train = test: one fit for all clusters and both sets; every problem is its own nearest."""
    fitted, searched = [], []
    fit, knn = LM.fit_mu_many, NB.exact_knn
    monkeypatch.setattr(LM, "fit_mu_many", lambda *a, **k: fitted.append(len(a[0])) or fit(*a, **k))
    monkeypatch.setattr(NB, "exact_knn", lambda test, *a, **k: searched.append(test.count()) or knn(test, *a, **k))
    cfg = SEL.RunConfig(model="label_model", model_class="cluster", class_balance="labels", normalize=None)
    results, _, _ = SEL.run(_scores(spark), V, cfg)
    rows = results.collect()
    assert fitted == [2] and sum(searched) == 0
    assert len(rows) == 120 and {r["distance"] for r in rows} == {0.0}
    by = {(r["set"], r["problem_id"]): (r["top1_idx"], r["model_id"]) for r in rows}
    assert all(by["train", p] == by["test", p] for p in range(60))


def test_only_test_problems_search_their_cluster(spark, monkeypatch):
    searched, knn = [], NB.exact_knn
    monkeypatch.setattr(NB, "exact_knn", lambda test, *a, **k: searched.append(test.count()) or knn(test, *a, **k))
    results, _, _ = SEL.run(_scores(spark), V, SEL.RunConfig(model_class="cluster", train_split=0.8, normalize=None))
    rows = results.collect()
    asked = sum(r["set"] == "test" for r in rows)
    assert 0 < asked < 30 and searched[0] == asked
    assert all(r["distance"] == 0.0 for r in rows if r["set"] == "train") and all(r["distance"] is not None for r in rows)
