"""Ranks of few and of many groups, and the normalisers built on them, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pickwise.functions import isotonic
from pickwise.functions.quantiles import from_bits, grouped_ranks, long_scores, ordered_bits, select_ranks, values_at
from pickwise.operators import scores as S


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=30))
def test_bits_keep_the_order_and_come_back(values):
    x = np.array(values)
    bits = ordered_bits(x)
    assert np.array_equal(from_bits(bits), x + 0.0)
    assert np.array_equal(np.argsort(bits, kind="stable"), np.argsort(x + 0.0, kind="stable"))


def test_many_ranks_of_many_columns_and_groups_together(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "a": rng.normal(size=n) * 1e6, "b": np.round(rng.random(n), 2) - 0.5, "c": np.where(rng.random(n) < 0.4, 0.0, 10.0 ** rng.uniform(-300, 300, n))})
    pdf.loc[pdf.index % 7 == 0, "b"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g long, a double, b double, c double").repartition(6)
    wants = {(g, c): sorted(set(rng.integers(1, 6_000, 400).tolist()) | {1}) for g in range(3) for c in "abc"}
    found = select_ranks(df, wants, "g")
    for (g, c), ranks in wants.items():
        s = np.sort(pdf[pdf.g == g][c].dropna().to_numpy())
        assert found[g, c] == {r: s[r - 1] for r in ranks if r <= len(s)}
    whole = select_ranks(df, {(None, "a"): range(1, n + 1), (None, "b"): [1, 5, n]})
    assert [whole[None, "a"][r] for r in range(1, n + 1)] == np.sort(pdf.a).tolist()
    assert set(whole[None, "b"]) == {1, 5} and select_ranks(df.limit(0), {(None, "a"): [1]}) == {(None, "a"): {}}


def hot(rng, n=9_000, ties=4):
    """One problem with a third of all rows, one column of few values."""
    pid = np.where(rng.random(n) < 1 / 3, 7, rng.integers(100, 100 + n // 20, n))
    rows = pd.DataFrame({"problem_id": pid, "a": rng.normal(size=n) * 3, "b": rng.integers(0, ties, n) * 2.5})
    rows["sample_idx"] = rows.groupby("problem_id").cumcount()
    rows["y"] = (rng.random(n) < 0.4).astype(int)
    rows.loc[rng.random(n) < 0.1, "a"] = None
    return rows


def table(spark, pdf):
    return spark.createDataFrame(pdf[["problem_id", "sample_idx", "y", "a", "b"]].astype(object).where(pdf.notna(), None), "problem_id long, sample_idx int, y int, a double, b double")


def test_a_hot_group_is_spread_over_the_tasks(spark):
    """A third of all rows in one problem, two fifths of its scores equal: no range partition of the sort holds over twice the mean."""
    rows = hot(np.random.default_rng(2), ties=2)
    scores = long_scores(table(spark, rows), ["a", "b"], "problem_id", "sample_idx")
    sizes = [r[0] for r in scores.repartitionByRange(8, "problem_id", "verifier", "score", "sample_idx").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    ranked, groups = grouped_ranks(scores, ["problem_id"], ["sample_idx"])
    middle = groups.select("problem_id", "verifier", (F.col("__start") + F.floor(F.col("n") / 2)).cast("long").alias("__at"))
    got = {(r["problem_id"], r["verifier"]): r["value"] for r in values_at(ranked, middle).collect()}
    for v in "ab":
        for pid, own in rows.groupby("problem_id")[v]:
            s = np.sort(own.dropna().to_numpy())
            assert not len(s) or got[pid, v] == s[len(s) // 2]


@pytest.mark.parametrize("normal", [False, True])
def test_quantiles_of_problems_above_and_below_the_number_of_levels(spark, normal):
    rows = hot(np.random.default_rng(3), n=3_000)
    got = S._quantile_per_problem(table(spark, rows), ["a", "b"], 50, normal).toPandas().set_index(["problem_id", "sample_idx"])
    sizes = rows.groupby("problem_id").size()
    assert sizes.max() > 500 and (sizes < 50).any()
    for pid, own in rows.groupby("problem_id"):
        for v in "ab":
            x = own[v].to_numpy(float)
            known = x[~np.isnan(x)]
            if not len(known) or np.isin(known, (-1, 0, 1)).all() or (known.min() >= 0 and known.max() <= 1):
                want = x
            else:
                s, n, m = np.sort(known), len(known), min(len(known), 50)
                levels, at = np.linspace(0, 1, m), np.arange(m) * (n - 1) / max(1, m - 1)
                low = at.astype(int)
                qs = s[low] + (s[np.minimum(low + 1, n - 1)] - s[low]) * (at - low)
                want = S._quantile_map(x, qs, levels, normal)
            have = got.loc[pid].loc[own.sample_idx, v].to_numpy(float)
            np.testing.assert_allclose(have, want, atol=1e-9, equal_nan=True)


def test_winsorize_and_thresholds_of_a_hot_problem(spark):
    rows = hot(np.random.default_rng(4))
    df = table(spark, rows)
    clipped = S.winsorize(df, ["a"], scope="per_problem").toPandas().set_index(["problem_id", "sample_idx"])["a"]
    votes = S.binarize_per_problem(df, ["a"]).toPandas().set_index(["problem_id", "sample_idx"])["a"]
    for pid, own in rows.groupby("problem_id"):
        x = own["a"].to_numpy(float)
        s = np.sort(x[~np.isnan(x)])
        if not len(s):
            continue
        lo, hi = (s[max(1, int(np.ceil(p * len(s)))) - 1] for p in (0.05, 0.95))
        if not (s[0] >= 0 and s[-1] <= 1) and hi > lo:
            want = np.clip(x, lo, hi)
            want = want if lo >= 0 and hi <= 1 else (want - lo) / (hi - lo)
            np.testing.assert_allclose(clipped.loc[pid].loc[own.sample_idx].to_numpy(float), want, atol=1e-12, equal_nan=True)
        voting = np.sort(x[~np.isnan(x) & (x != -1)])
        k = min(len(voting), max(1, int(np.ceil((1 - own.y.mean()) * len(voting)))))
        want = np.where(np.isnan(x), 0.0, (x >= voting[k - 1]).astype(float))
        assert votes.loc[pid].loc[own.sample_idx].to_numpy(float).tolist() == want.tolist()


@pytest.mark.parametrize("w", [1, 2, 3, 4, 9])
def test_smoothing_across_blocks(spark, monkeypatch, w):
    monkeypatch.setattr(S, "SMOOTH_BLOCK", 5)
    rng = np.random.default_rng(w)
    rows = pd.DataFrame({"problem_id": np.repeat([1, 2, 3, 4], [200, 1, 3, 60]), "a": rng.normal(size=264)})
    rows["sample_idx"] = rows.groupby("problem_id").cumcount() * 3
    rows.loc[[20, 21, 150], "a"] = None
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None)[["problem_id", "sample_idx", "a"]], "problem_id long, sample_idx int, a double").repartition(5)
    got = S.smooth_scores(df, ["a"], w).toPandas().sort_values(["problem_id", "sample_idx"])
    assert len(got) == len(rows)
    for pid, own in rows.groupby("problem_id"):
        x = own["a"].to_numpy(float)
        padded = np.concatenate([np.zeros(w // 2), x, np.zeros(w - 1 - w // 2)])
        want = np.array([padded[i:i + w].sum() / w for i in range(len(x))])
        np.testing.assert_allclose(got[got.problem_id == pid]["a"].to_numpy(float), want, atol=1e-12, equal_nan=True)


def brute_isotonic(x, y):
    """Largest over starts of the least over ends of the means, over distinct scores."""
    ux, inv = np.unique(x, return_inverse=True)
    w = np.bincount(inv).astype(float)
    s = np.concatenate([[0], np.cumsum(np.bincount(inv, weights=y))])
    n = np.concatenate([[0], np.cumsum(w)])
    fit = [max(min((s[k + 1] - s[j]) / (n[k + 1] - n[j]) for k in range(i, len(ux))) for j in range(i + 1)) for i in range(len(ux))]
    return np.array(fit)[inv]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 5)), min_size=1, max_size=40), st.lists(st.integers(1, 39), max_size=4))
def test_blocks_of_pieces_merge_to_the_fit_of_the_whole(rows, cuts):
    rows.sort(key=lambda r: r[0])
    x, y = (np.array([r[i] for r in rows], float) for i in (0, 1))
    edges = sorted({0, len(x), *(c for c in cuts if c < len(x))})
    pieces = [b for a, b_ in zip(edges, edges[1:], strict=False) for b in isotonic.summary(0, np.arange(a, b_), x[a:b_], y[a:b_])]
    found = isotonic.merged(isotonic._table(pieces)).to_pylist()
    got = np.concatenate([np.full(b["last"] - b["first"] + 1, b["total"] / b["weight"]) for b in found])
    np.testing.assert_allclose(got, brute_isotonic(x, y), atol=1e-12)
    np.testing.assert_allclose(isotonic.fitted(x, y), got, atol=1e-12)


def test_isotonic_calibration_of_a_hot_problem_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(isotonic, "PIECE", 100)
    rows = hot(np.random.default_rng(5), n=1_500)
    got = S.calibrate_isotonic(table(spark, rows), ["a", "b"]).toPandas().set_index(["problem_id", "sample_idx"])
    assert len(got) == len(rows) and list(got.columns) == ["y", "a", "b"]
    for pid, own in rows.groupby("problem_id"):
        own = own.sort_values("sample_idx")
        for v in "ab":
            x = own[v].to_numpy(float)
            known = ~np.isnan(x)
            want = np.full(len(x), np.nan)
            if known.any():
                want[known] = brute_isotonic(x[known], np.linspace(0, 1, known.sum()))
            np.testing.assert_allclose(got.loc[pid].loc[own.sample_idx, v].to_numpy(float), want, atol=1e-9, equal_nan=True)
