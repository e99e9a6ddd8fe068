"""Second moments of verifier scores and the label-free continuous (triplet) model.

``gram`` is one aggregate pass (partial sums per task, merged on the driver's
side as a single row): sum(x_i x_j), sums and counts for every pair.  Above
``wide_limit`` columns it switches to ``mapInPandas`` partial Gram matrices
(one V x V NumPy product per Arrow batch) summed by (i, j), so the generated
aggregate code stays small.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import sum_cols


def _complete(df, cols):
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond)


def gram(df: DataFrame, cols, wide_limit: int = 16) -> DataFrame:
    """Long table (vi, vj, n, m2 = E[x_i x_j], cov = sample covariance) over rows where all
    ``cols`` are present (NumPy on a NaN-free matrix)."""
    d = _complete(df.select(*cols), cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
    if len(cols) <= wide_limit:
        aggs = [F.count(F.lit(1)).alias("n")]
        aggs += [F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]
        aggs += [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs if i <= j]
        aggs += [F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs if i <= j]
        row = d.agg(*aggs)
        items = [F.struct(F.lit(cols[i]).alias("vi"), F.lit(cols[j]).alias("vj"), F.col("n"),
                          (F.col(f"p{min(i, j)}_{max(i, j)}") / F.col("n")).alias("m2"),
                          F.col(f"c{min(i, j)}_{max(i, j)}").alias("cov")) for i, j in pairs]
        return row.select(F.explode(F.array(*items)).alias("g")).select("g.*")
    v = len(cols)

    def partial(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            s = x.sum(axis=0)
            p = x.T @ x
            yield pd.DataFrame({"i": np.repeat(np.arange(v), v), "j": np.tile(np.arange(v), v),
                                "p": p.ravel(), "si": np.repeat(s, v), "sj": np.tile(s, v),
                                "n": np.full(v * v, len(x))})

    parts = d.mapInPandas(partial, "i int, j int, p double, si double, sj double, n long")
    tot = parts.groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("si").alias("si"),
                                      F.sum("sj").alias("sj"), F.sum("n").alias("n"))
    names = F.array(*[F.lit(c) for c in cols])
    n = F.col("n")
    return tot.select(F.element_at(names, F.col("i") + 1).alias("vi"), F.element_at(names, F.col("j") + 1).alias("vj"),
                      n, (F.col("p") / n).alias("m2"),
                      ((F.col("p") - F.col("si") * F.col("sj") / n) / (n - 1)).alias("cov"))


def gram_matrix(df: DataFrame, cols, kind: str = "m2") -> np.ndarray:
    """V x V NumPy matrix of ``kind`` (m2 or cov) on the driver (V-sized)."""
    idx = {c: i for i, c in enumerate(cols)}
    out = np.zeros((len(cols), len(cols)))
    for r in gram(df, cols).collect():
        out[idx[r["vi"]], idx[r["vj"]]] = r[kind]
    return out


def mean_row_variance(df: DataFrame, cols) -> DataFrame:
    """Mean over rows of the population variance across the verifier columns of that row."""
    m = sum_cols(cols) / F.lit(float(len(cols)))
    var = sum_cols([(F.col(c) - m) * (F.col(c) - m) for c in cols]) / F.lit(float(len(cols)))
    return _complete(df, cols).agg(F.avg(var).alias("var_y"))


def triplet_fit(df: DataFrame, verifiers, center: bool = False) -> DataFrame:
    """Continuous label-free model: O = X^T X / n (``center=True``: covariance, Q35),
    var_y = mean row variance, cov(v_i, Y) = mean over triplets of sqrt(O_ij O_ik var_y / O_jk);
    V = 2 and V = 1 closed forms.  Weights w = O^-1 cov solve p1 = w . x.

    Returns (verifier, cov_y, weight, var_y).  Triplets with |O_jk| < 1e-12 or a
    negative radicand are skipped (NumPy would give NaN)."""
    o = gram_matrix(df, verifiers, "cov" if center else "m2")
    var_y = mean_row_variance(df, verifiers).first()["var_y"]
    mean = df.agg(F.avg(verifiers[0])).first()[0] if len(verifiers) == 1 else None
    acc, w = triplet_solution(o, var_y, mean)
    pdf = pd.DataFrame({"verifier": verifiers, "cov_y": acc, "weight": w, "var_y": var_y})
    return df.sparkSession.createDataFrame(pdf, "verifier string, cov_y double, weight double, var_y double")


def triplet_solution(o: np.ndarray, var_y: float, mean: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(cov(v_i, Y), weights) from the second moments; ``mean`` of the verifier when there is only one."""
    m = len(o)
    acc = np.zeros(m)
    if m >= 3:
        coll = {i: [] for i in range(m)}
        for i, j, k in itertools.combinations(range(m), 3):
            for a, b, c in ((i, j, k), (j, i, k), (k, i, j)):
                den = o[b, c]
                rad = o[a, b] * o[a, c] * var_y / den if abs(den) >= 1e-12 else -1.0
                if rad >= 0:
                    coll[a].append(float(np.sqrt(rad)))
        acc = np.array([np.mean(coll[i]) if coll[i] else np.nan for i in range(m)])
    elif m == 2:
        acc = np.array([np.sqrt(o[0, 1] * var_y / (o[1, 1] + 1e-8)), np.sqrt(o[1, 0] * var_y / (o[0, 0] + 1e-8))])
    elif m == 1:
        acc = np.array([mean])
    try:
        w = np.linalg.solve(o, acc)
    except np.linalg.LinAlgError:
        w = np.linalg.pinv(o) @ acc
    return acc, w


def triplet_weights(o: np.ndarray, var_y: float, mean: float | None) -> np.ndarray:
    return triplet_solution(o, var_y, mean)[1]


def triplet_score(df: DataFrame, params: DataFrame, verifiers, out: str = "p1") -> DataFrame:
    """p1 = sum_i w_i x_i (weights are V numbers, inlined as literals)."""
    w = {r["verifier"]: r["weight"] for r in params.collect()}
    return df.withColumn(out, sum_cols([F.col(v) * F.lit(float(w[v])) for v in verifiers]))
