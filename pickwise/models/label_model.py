"""Label models that learn verifier accuracies without labels (ops 83, 85).

``label_model_fit``: votes in {1, 0, -1 = abstain}; one-hot indicators
psi_i = [1{v_i = 0}, 1{v_i = 1}].  Under conditional independence given y,
E[psi_i psi_j^T] = sum_y P(y) mu_i(y) mu_j(y)^T for i != j and E[psi_i] =
sum_y P(y) mu_i(y), with mu_i(y) = [P(v_i=0|y), P(v_i=1|y)].  The moments are
one aggregate pass over all rows (V(V-1)/2 * 4 + 2V sums); mu is then fitted on
the driver by minimising the squared residual of both equations (the
matrix-completion label model of Ratner et al., 2019), starting from "better
than chance" accuracies.  Only moments - never rows - reach the driver.

``class_balance_tensor``: label-free prior from third moments of +-1 votes on
rows where a triple of verifiers all vote: with symmetric noise,
E[l_i l_j l_k] = a_i a_j a_k E[Y] and E[l_i l_j] = a_i a_j, so
E[Y] = m_ijk / (a_i a_j a_k); averaged over up to 30 seeded triples (Q19).
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import sum_cols


def _moment_sums(verifiers):
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(verifiers):
        for s in (0, 1):
            aggs.append(F.sum((F.col(a) == s).cast("double")).alias(f"m{i}_{s}"))
    for i, j in itertools.combinations(range(len(verifiers)), 2):
        for s in (0, 1):
            for t in (0, 1):
                aggs.append(F.sum(((F.col(verifiers[i]) == s) & (F.col(verifiers[j]) == t)).cast("double"))
                            .alias(f"o{i}_{j}_{s}{t}"))
    return aggs


def _moments_of(row: dict, v: int):
    n = row["n"]
    m1 = np.array([[row[f"m{i}_{s}"] / n for s in (0, 1)] for i in range(v)])
    o = np.zeros((v, v, 2, 2))
    for i, j in itertools.combinations(range(v), 2):
        for s in (0, 1):
            for t in (0, 1):
                o[i, j, s, t] = o[j, i, t, s] = row[f"o{i}_{j}_{s}{t}"] / n
    return n, m1, o


def vote_moments(df: DataFrame, verifiers):
    """(n, first moments (V,2), second moments (V,V,2,2)) of the one-hot votes, one pass."""
    return _moments_of(df.agg(*_moment_sums(verifiers)).first().asDict(), len(verifiers))


def fit_mu_many(m1, o, cb, steps=4000, lr=0.01):
    """Adam on the moment residuals of many models at once: m1 (models, V, 2), o (models, V, V, 2, 2), cb (models).

    Returns mu (models, V, 2 vote values, 2 classes)."""
    models, v = m1.shape[:2]
    p = np.stack([1.0 - np.asarray(cb, float), np.asarray(cb, float)], axis=1)
    nonab = m1.sum(axis=2)
    mu = np.zeros((models, v, 2, 2))
    mu[:, :, 0, 0] = mu[:, :, 1, 1] = 0.7 * nonab
    mu[:, :, 1, 0] = mu[:, :, 0, 1] = 0.3 * nonab
    mask = (1.0 - np.eye(v))[None, :, :, None, None]
    m_adam = np.zeros_like(mu)
    v_adam = np.zeros_like(mu)
    for t in range(1, steps + 1):
        weighted = mu * p[:, None, None, :]
        r2 = (np.einsum("misy,mjty->mijst", mu, weighted) - o) * mask
        r1 = weighted.sum(axis=3) - m1
        g = 4 * np.einsum("mijst,mjty->misy", r2, weighted) + 2 * r1[..., None] * p[:, None, None, :]
        m_adam = 0.9 * m_adam + 0.1 * g
        v_adam = 0.999 * v_adam + 0.001 * g * g
        mu -= lr * (m_adam / (1 - 0.9 ** t)) / (np.sqrt(v_adam / (1 - 0.999 ** t)) + 1e-12)
        mu = np.clip(mu, 1e-6, 1.0)
    return mu


def label_model_fit(df: DataFrame, verifiers, class_balance: float | None = None, clip=(0.01, 0.99)) -> DataFrame:
    """Parameter table (verifier, p_s0_y0, p_s1_y0, p_s0_y1, p_s1_y1, class_balance).

    ``class_balance``: given prior; None -> the tensor estimate (no labels used)."""
    return label_model_fits(df, verifiers, class_balance, None, clip)[None]


def label_model_fits(df: DataFrame, verifiers, class_balance: float | dict | None = None, group: str | None = None, clip=(0.01, 0.99)) -> dict:
    """{group value: parameter table as of :func:`label_model_fit`}: the sums of all groups from one pass (None: one group).

    ``class_balance``: one prior, or a prior by group value."""
    by, v = [group] if group else [], len(verifiers)
    sums = [*_moment_sums(verifiers), *(_triple_sums(verifiers) if class_balance is None else [])]
    found = {r[group] if group else None: r.asDict() for r in df.groupBy(*by).agg(*sums).collect()}
    if not found:
        return {}
    cb = np.array([float(class_balance[g] if isinstance(class_balance, dict) else class_balance if class_balance is not None
                         else _balance_of_row(row, verifiers)) for g, row in found.items()])
    m1, o = (np.stack(x) for x in zip(*[_moments_of(row, v)[1:] for row in found.values()], strict=True))
    mu = np.clip(fit_mu_many(m1, o, cb), clip[0], clip[1])
    out = {}
    for g, own, prior in zip(found, mu, cb, strict=True):
        rows = [(name, float(own[i, 0, 0]), float(own[i, 1, 0]), float(own[i, 0, 1]), float(own[i, 1, 1]), float(prior))
                for i, name in enumerate(verifiers)]
        out[g] = df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=[
            "verifier", "p_s0_y0", "p_s1_y0", "p_s0_y1", "p_s1_y1", "class_balance"]))
    return out


def label_model_score(df: DataFrame, params: DataFrame, verifiers, out: str = "p1") -> DataFrame:
    """p1 from log P(y) + sum over non-abstaining verifiers of log P(vote | y); the V-row
    parameter table is inlined as literals (one projection, no join)."""
    prm = {r["verifier"]: r for r in params.collect()}
    cb = next(iter(prm.values()))["class_balance"]
    terms = []
    for v in verifiers:
        r = prm[v]
        w1 = math.log(r["p_s1_y1"]) - math.log(r["p_s1_y0"])
        w0 = math.log(r["p_s0_y1"]) - math.log(r["p_s0_y0"])
        terms.append(F.when(F.col(v) == 1, F.lit(w1)).when(F.col(v) == 0, F.lit(w0)).otherwise(F.lit(0.0)))
    logit = sum_cols(terms) + F.lit(math.log(cb) - math.log(1 - cb))
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))


def _triples(v: int, seed: int, limit: int = 30):
    allt = list(itertools.combinations(range(v), 3))
    if len(allt) <= limit:
        return allt
    key = lambda t: hashlib.md5(f"{seed}|{t}".encode()).hexdigest()
    return sorted(allt, key=key)[:limit]


def _triple_sums(verifiers, seed: int = 42):
    if len(verifiers) < 3:
        return []
    pm = {a: F.when(F.col(a) == 1, 1.0).when(F.col(a) == 0, -1.0) for a in verifiers}
    aggs = []
    for t, (i, j, k) in enumerate(_triples(len(verifiers), seed)):
        a, b, c = pm[verifiers[i]], pm[verifiers[j]], pm[verifiers[k]]
        both = a.isNotNull() & b.isNotNull() & c.isNotNull()
        aggs += [F.count_if(both).alias(f"n{t}"), F.sum(F.when(both, a * b)).alias(f"ab{t}"),
                 F.sum(F.when(both, a * c)).alias(f"ac{t}"), F.sum(F.when(both, b * c)).alias(f"bc{t}"),
                 F.sum(F.when(both, a * b * c)).alias(f"abc{t}")]
    return aggs


def _balance_of_row(row: dict, verifiers, seed: int = 42) -> float:
    if len(verifiers) < 3:
        return 0.5
    return balance_of([[row[f"{c}{t}"] or 0 for c in ("n", "ab", "ac", "bc", "abc")] for t in range(len(_triples(len(verifiers), seed)))])


def class_balance_tensor_value(df: DataFrame, verifiers, seed: int = 42) -> float:
    """Label-free P(y=1) from third moments of +-1 votes (see module docstring)."""
    sums = _triple_sums(verifiers, seed)
    return _balance_of_row(df.agg(*sums).first().asDict(), verifiers, seed) if sums else 0.5


def balance_of(triples) -> float:
    """P(y=1) from the sums (n, ab, ac, bc, abc) of triples of +-1 votes; one half without a usable triple."""
    ests = []
    for n, *sums in triples:
        if not n:
            continue
        ab, ac, bc, abc = (x / n for x in sums)
        if min(abs(ab), abs(ac), abs(bc)) < 1e-12:
            continue
        ai, aj, ak = (math.sqrt(abs(ab * ac / bc)), math.sqrt(abs(ab * bc / ac)), math.sqrt(abs(ac * bc / ab)))
        ests.append(min(1.0, max(0.0, (1.0 + abc / (ai * aj * ak)) / 2.0)))
    return float(np.mean(ests)) if ests else 0.5


def class_balance_tensor(df: DataFrame, verifiers, seed: int = 42) -> DataFrame:
    return df.sparkSession.createDataFrame([(class_balance_tensor_value(df, verifiers, seed),)], "class_balance double")
