"""Verifier diagnostics (ops 119-130): problem x verifier matrices, moments, agreement, NLL gain.

Problem x verifier matrices are long tables (problem_id, verifier, value) from one
explode + grouped aggregate; V x V summaries are one aggregate pass; only V x V
numbers reach the driver (for the matrix inverse).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import sum_cols
from pickwise.models.moments import gram_matrix
from pickwise.operators.metrics import _long, verifier_top1


def verifier_selection_matrix(df: DataFrame, verifiers) -> DataFrame:
    """(problem_id, verifier, value): label of the verifier's own top sample."""
    return verifier_top1(df, verifiers).select("problem_id", "verifier", F.col("top1_label").alias("value"))


def _acc_long(df, verifiers):
    lg = _long(df, verifiers)
    return lg.withColumn("__acc", ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double"))


def verifier_accuracy_matrix(df: DataFrame, verifiers) -> DataFrame:
    """(problem_id, verifier, value): mean over samples of ((score >= 0.5) == y)."""
    return _acc_long(df, verifiers).groupBy("problem_id", "verifier").agg(F.avg("__acc").alias("value"))


def verifier_accuracy_variance(df: DataFrame, verifiers) -> DataFrame:
    """Population variance over samples of the same 0/1 accuracy."""
    return _acc_long(df, verifiers).groupBy("problem_id", "verifier").agg(F.var_pop("__acc").alias("value"))


def score_variance(df: DataFrame, verifiers) -> DataFrame:
    """Population variance of the scores of each (problem, verifier)."""
    return _long(df, verifiers).groupBy("problem_id", "verifier").agg(F.var_pop("score").alias("value"))


def precision_matrix(df: DataFrame, verifiers) -> DataFrame:
    """(vi, vj, cov, precision, partial_corr): sample covariance of the scores over all rows,
    its inverse (pseudo-inverse when singular) and -P_ij / sqrt(P_ii P_jj) with unit diagonal."""
    cov = gram_matrix(df, verifiers, "cov")
    try:
        inv = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(cov)
    d = np.sqrt(np.diag(inv))
    pc = -inv / np.outer(d, d)
    np.fill_diagonal(pc, 1.0)
    rows = [(a, b, float(cov[i, j]), float(inv[i, j]), float(pc[i, j]))
            for i, a in enumerate(verifiers) for j, b in enumerate(verifiers)]
    return df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["vi", "vj", "cov", "precision", "partial_corr"]))


def class_distribution(df: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of the per-problem positive share over [0, 1] in ``bins`` equal bins (the last
    bin closed), as (bin, n_problems)."""
    per = df.groupBy("problem_id").agg(F.avg("y").alias("pos"))
    b = F.least(F.floor(F.col("pos") * F.lit(bins)).cast("int"), F.lit(bins - 1))
    return per.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_problems"))


def class_quartiles(df: DataFrame) -> DataFrame:
    """25th / 50th / 75th percentile (linear interpolation) of the per-problem positive share."""
    per = df.groupBy("problem_id").agg(F.avg("y").alias("pos"))
    return per.agg(F.percentile("pos", 0.25).alias("q25"), F.percentile("pos", 0.5).alias("q50"),
                   F.percentile("pos", 0.75).alias("q75"))


def _problem_means(df, verifiers):
    return df.groupBy("problem_id").agg(*[F.avg(v).alias(v) for v in verifiers])


def verifier_order_by_accuracy(df: DataFrame, verifiers) -> list[str]:
    """Best first by mean over problems of the per-problem (score >= 0.5) == y accuracy; ties
    put the later verifier first (a reversed stable ascending sort)."""
    acc = verifier_accuracy_matrix(df, verifiers).groupBy("verifier").agg(F.avg("value").alias("a"))
    vals = {r["verifier"]: r["a"] for r in acc.collect()}
    asc = sorted(range(len(verifiers)), key=lambda i: vals[verifiers[i]])
    return [verifiers[i] for i in asc[::-1]]


def ensemble_variance(df: DataFrame, verifiers) -> DataFrame:
    """For k = 1..V best verifiers: mean over problems of p(1-p), p = mean over the k of the
    problem's mean scores; ``is_min`` marks the first k with the smallest value."""
    order = verifier_order_by_accuracy(df, verifiers)
    pm = _problem_means(df, verifiers)
    items = []
    for k in range(1, len(order) + 1):
        p = sum_cols(order[:k]) / F.lit(float(k))
        items.append(F.avg(p * (F.lit(1.0) - p)).alias(f"k{k}"))
    row = pm.agg(*items)
    out = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("variance"))
                                         for k in range(1, len(order) + 1)])).alias("e")).select("e.*")
    rows = out.collect()  # V rows
    best = min(rows, key=lambda r: (r["variance"], r["k"]))["k"]
    return out.withColumn("is_min", F.col("k") == F.lit(best))


def agreement_matrix(df: DataFrame, verifiers) -> DataFrame:
    """(vi, vj, agreement): share of problems where (mean score > 0.5) agrees for both verifiers."""
    pm = _problem_means(df, verifiers)
    aggs = [F.avg(((F.col(a) > 0.5) == (F.col(b) > 0.5)).cast("double")).alias(f"{a}__{b}")
            for a in verifiers for b in verifiers]
    row = pm.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("vi"), F.lit(b).alias("vj"),
                                                   F.col(f"{a}__{b}").alias("agreement"))
                                          for a in verifiers for b in verifiers])).alias("e")).select("e.*")


def vote_margin(df: DataFrame, verifiers) -> DataFrame:
    """Histogram of |votes for - votes against| per problem, a vote = (mean score > 0.5)."""
    pm = _problem_means(df, verifiers)
    votes = sum_cols([(F.col(v) > 0.5).cast("int") for v in verifiers])
    margin = F.abs(votes - (F.lit(len(verifiers)) - votes))
    return pm.groupBy(margin.alias("margin")).agg(F.count(F.lit(1)).alias("n_problems"))


def _nll(df, p1, eps=1e-6):
    p = F.least(F.greatest(F.col(p1), F.lit(eps)), F.lit(1 - eps))
    y = F.col("y")
    return -(y * F.ln(p) + (F.lit(1) - y) * F.ln(F.lit(1.0) - p))


def likelihood_gain(df: DataFrame, p1: str = "p1", eps: float = 1e-6) -> DataFrame:
    """Per-sample NLL of p1 (clipped) minus the entropy of the problem's mean label (clipped);
    returns the averages (nll, gain) over all samples."""
    # sums per problem are enough: one partial aggregate, no join back to the samples
    nll = _nll(df, p1, eps)
    per = df.groupBy("problem_id").agg(F.avg("y").alias("__m"), F.sum(nll).alias("__s"), F.count(nll).alias("__n"))
    m = F.least(F.greatest(F.col("__m"), F.lit(eps)), F.lit(1 - eps))
    ent = -(m * F.ln(m) + (F.lit(1.0) - m) * F.ln(F.lit(1.0) - m))
    return per.agg((F.sum("__s") / F.sum("__n")).alias("nll"), (F.sum(F.col("__s") - ent * F.col("__n")) / F.sum("__n")).alias("gain"))


def top_nll(df: DataFrame, p1: str = "p1", eps: float = 1e-6) -> DataFrame:
    """NLL and gain at each problem's top sample (highest p1, lowest sample_idx), averaged."""
    per = df.groupBy("problem_id").agg(
        F.avg("y").alias("__m"),
        F.max_by(F.struct(F.col("y"), F.col(p1).alias("__p")), F.struct(F.col(p1), -F.col("sample_idx"))).alias("t"))
    m = F.least(F.greatest(F.col("__m"), F.lit(eps)), F.lit(1 - eps))
    ent = -(m * F.ln(m) + (F.lit(1.0) - m) * F.ln(F.lit(1.0) - m))
    p = F.least(F.greatest(F.col("t.__p"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("t.y")
    nll = -(y * F.ln(p) + (F.lit(1) - y) * F.ln(F.lit(1.0) - p))
    return per.agg(F.avg(nll).alias("top_nll"), F.avg(nll - ent).alias("top_gain"))
