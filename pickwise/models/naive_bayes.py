"""Naive Bayes over binary votes: TPR/TNR per verifier from conditional averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nb_fit(df: DataFrame, verifiers, clip=(0.0, 1.0), group_col: str | None = None) -> DataFrame:
    """TPR_v = P(v=1 | y=1), TNR_v = P(v=0 | y=0) clipped, cb = mean(y); one pass.

    Votes must be 0/1 (the reference asserts two distinct values).  With
    ``group_col`` one parameter row per group (groups with one label value
    are skipped, as the reference does for naive Bayes).
    """
    lo, hi = clip
    y = F.col("y")

    def clipped(c):
        return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))

    aggs = [F.avg(y).alias("cb"), F.count(F.lit(1)).alias("n_fit")]
    for v in verifiers:
        aggs.append(clipped(F.avg(F.when(y == 1, (F.col(v) == 1).cast("double")))).alias(f"{v}__tpr"))
        aggs.append(clipped(F.avg(F.when(y == 0, (F.col(v) == 0).cast("double")))).alias(f"{v}__tnr"))
    if group_col is None:
        return df.agg(*aggs)
    out = df.groupBy(group_col).agg(*aggs, F.count_distinct(y).alias("__labels"))
    return out.filter(F.col("__labels") == 2).drop("__labels")


def np_log(x) -> F.Column:
    """Natural log as NumPy computes it: log(0) = -inf, log(<0) = NaN (Spark's ln gives NULL)."""
    return (F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))


def nb_log_tables(params: DataFrame, verifiers) -> DataFrame:
    """Add the log-likelihood of each vote value to the (tiny) parameter table:
    ``{v}__a1`` = log P(v=1|y=1), ``{v}__b1`` = log P(v=0|y=1), ``{v}__a0`` = log P(v=1|y=0),
    ``{v}__b0`` = log P(v=0|y=0), and the log priors.  Computed once per parameter row."""
    one = F.lit(1.0)
    cols = [np_log(F.col("cb")).alias("__lcb1"), np_log(one - F.col("cb")).alias("__lcb0")]
    for v in verifiers:
        tpr, tnr = F.col(f"{v}__tpr"), F.col(f"{v}__tnr")
        cols += [np_log(tpr).alias(f"{v}__a1"), np_log(one - tpr).alias(f"{v}__b1"),
                 np_log(one - tnr).alias(f"{v}__a0"), np_log(tnr).alias(f"{v}__b0")]
    return params.select("*", *cols)


def nb_log_odds(verifiers, values: dict | None = None) -> F.Column:
    """log P(y=1 | x) - log P(y=0 | x) for 0/1 votes: per verifier one of two precomputed logs
    (other vote values give NaN: naive Bayes needs binary votes).  ``values``: the log table as
    numbers (inlined literals); without it the columns of a joined table are used."""
    nan = F.lit(float("nan"))

    def ref(name):
        return F.lit(values[name]) if values is not None else F.col(name)

    def pick(v, cls):
        return (F.when(F.col(v) == 1, ref(f"{v}__a{cls}")).when(F.col(v) == 0, ref(f"{v}__b{cls}"))
                .otherwise(nan))

    l1 = reduce(lambda a, b: a + b, [pick(v, 1) for v in verifiers]) + ref("__lcb1")
    l0 = reduce(lambda a, b: a + b, [pick(v, 0) for v in verifiers]) + ref("__lcb0")
    return l1 - l0


def nb_score(df: DataFrame, params: DataFrame, verifiers, group_col: str | None = None,
             out: str = "p1") -> DataFrame:
    """p1 = 1 / (1 + exp(l0 - l1)) (the logsumexp form) per sample.  One model: its 4V + 2
    log-likelihoods are inlined as literals (fit / transform); per-group models are joined."""
    tables = nb_log_tables(params, verifiers)
    if group_col is None:
        vals = tables.first().asDict()
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-nb_log_odds(verifiers, vals))))
    j = df.join(tables, group_col)
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-nb_log_odds(verifiers)))
    return j.select(*[F.col(c) for c in df.columns], p1.alias(out))
