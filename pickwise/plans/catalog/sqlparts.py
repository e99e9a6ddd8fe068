"""DuckDB oracle fragments shared by catalog modules (text builders, no execution).

Each builder returns a SELECT over a named relation so catalog entries can
chain them as CTEs.  Floats are rounded to 6 digits only in the final SELECT.
"""

from __future__ import annotations


def ids(src="src"):
    return f"{src}.problem_id, {src}.sample_idx"


def minmax_all(src, vs, keep=("problem_id", "sample_idx", "y")):
    stats = ", ".join(
        f"min({v}) AS {v}__min, max({v}) AS {v}__max, count({v}) AS {v}__n, "
        f"count_if({v} NOT IN (-1, 0, 1)) AS {v}__nd" for v in vs)
    exprs = ", ".join(
        f"CASE WHEN {v}__n = 0 OR {v}__nd = 0 OR ({v}__min >= 0 AND {v}__max <= 1) THEN {v} "
        f"ELSE ({v} - {v}__min) / nullif({v}__max - {v}__min, 0) END AS {v}" for v in vs)
    others = ", ".join(f"{src}.{k}" for k in keep)
    return f"SELECT {others}, {exprs} FROM {src}, (SELECT {stats} FROM {src}) st"


def binarize(src, vs, t=0.5, keep=("problem_id", "sample_idx", "y")):
    exprs = ", ".join(
        f"CAST(CASE WHEN {v} = -1 THEN -1 WHEN {v} >= {t} THEN 1 ELSE 0 END AS DOUBLE) AS {v}" for v in vs)
    return f"SELECT {', '.join(keep)}, {exprs} FROM {src}"


def nb_params(src, vs, lo=0.0, hi=1.0):
    parts = ["avg(y) AS cb"]
    for v in vs:
        parts.append(f"least(greatest(avg(CASE WHEN y = 1 THEN CAST({v} = 1 AS DOUBLE) END), {lo}::DOUBLE), {hi}::DOUBLE) AS {v}__tpr")
        parts.append(f"least(greatest(avg(CASE WHEN y = 0 THEN CAST({v} = 0 AS DOUBLE) END), {lo}::DOUBLE), {hi}::DOUBLE) AS {v}__tnr")
    return f"SELECT {', '.join(parts)} FROM {src}"


def nb_p1(src, params, vs, keep=("problem_id", "sample_idx", "y")):
    l1 = " + ".join(f"ln({v} * {v}__tpr + (1 - {v}) * (1 - {v}__tpr))" for v in vs) + " + ln(cb)"
    l0 = " + ".join(f"ln({v} * (1 - {v}__tnr) + (1 - {v}) * {v}__tnr)" for v in vs) + " + ln(1 - cb)"
    others = ", ".join(f"{src}.{k}" for k in keep)
    return f"SELECT {others}, 1.0 / (1.0 + exp(-(({l1}) - ({l0})))) AS p1 FROM {src}, {params}"


def top1(src, score="p1", by="problem_id"):
    return f"""SELECT {by}, CAST(sample_idx AS INT) AS top1_idx, CAST(y AS INT) AS top1_label, CAST(has_positive AS INT) AS has_positive,
  CAST(y = 1 AS INT) AS top1_positive,
  CAST(y = 1 AND has_positive = 1 AS INT) AS top1_tp, CAST(y = 1 AND has_positive = 0 AS INT) AS top1_fp,
  CAST(y = 0 AND has_positive = 0 AS INT) AS top1_tn, CAST(y = 0 AND has_positive = 1 AS INT) AS top1_fn
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, sample_idx) AS __rk,
             max(y) OVER (PARTITION BY {by}) AS has_positive FROM {src}) WHERE __rk = 1"""


def sample_metrics(src, score="p1", by="problem_id"):
    pred = f"({score} > 1 - {score})"
    return f"""SELECT {by}, avg(CASE WHEN {pred} = (y = 1) THEN 1 ELSE 0 END) AS sample_accuracy,
  count_if({pred} AND y = 1) AS sample_tp, count_if(NOT {pred} AND y = 0) AS sample_tn,
  count_if({pred} AND y = 0) AS sample_fp, count_if(NOT {pred} AND y = 1) AS sample_fn,
  count(*) AS num_samples FROM {src} GROUP BY {by}"""


def prediction_metrics(src, score="p1", by="problem_id"):
    return f"""SELECT {by}, CAST(sample_idx AS INT) AS prediction_idx, CAST(cls AS INT) AS prediction_class,
  CAST(cls = y AS INT) AS prediction_accuracy, CAST(cls = 1 AND y = 1 AS INT) AS prediction_tp,
  CAST(cls = 0 AND y = 0 AS INT) AS prediction_tn, CAST(cls = 1 AND y = 0 AS INT) AS prediction_fp,
  CAST(cls = 0 AND y = 1 AS INT) AS prediction_fn
FROM (SELECT *, CASE WHEN {score} > 1 - {score} THEN 1 ELSE 0 END AS cls,
        row_number() OVER (PARTITION BY {by} ORDER BY greatest(1 - {score}, {score}) DESC, sample_idx) AS __rk
      FROM {src}) WHERE __rk = 1"""


def summary(src, set_col="set"):
    return f"""SELECT {set_col}, count(*) AS n_problems, avg(top1_positive) AS select_acc, avg(sample_accuracy) AS sample_acc,
  CAST(sum(top1_tp) + sum(top1_tn) AS DOUBLE) / nullif(sum(top1_tp) + sum(top1_tn) + sum(top1_fp) + sum(top1_fn), 0) AS top1_acc,
  CAST(sum(top1_tp) AS BIGINT) AS select_tp, CAST(sum(top1_tn) AS BIGINT) AS select_tn,
  CAST(sum(top1_fp) AS BIGINT) AS select_fp, CAST(sum(top1_fn) AS BIGINT) AS select_fn,
  CAST(sum(sample_tp) AS BIGINT) AS sample_tp, CAST(sum(sample_tn) AS BIGINT) AS sample_tn,
  CAST(sum(sample_fp) AS BIGINT) AS sample_fp, CAST(sum(sample_fn) AS BIGINT) AS sample_fn
FROM {src} GROUP BY {set_col}"""


def round_cols(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)
