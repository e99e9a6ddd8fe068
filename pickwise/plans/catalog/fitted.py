"""Catalog: fitted models and scaling analyses (ops 83, 85, 87, 107-109, 112-116).

Iterative or numeric fits have no SQL oracle (rows-only check); their values
are checked in pytest against NumPy on the same rows.  The scaling grids of
fixed verifier order are plain SQL and carry an oracle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.models.label_model import class_balance_tensor, label_model_fit, label_model_score
from pickwise.models.logistic import logistic_fit, logistic_score
from pickwise.operators import metrics as M
from pickwise.operators import scaling as SC
from pickwise.operators.scores import minmax_all
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.catalog.groups import _split_bucket_sql
from pickwise.plans.catalog.metrics import _split_sql
from pickwise.plans.registry import register
from pickwise.plans.selection import weak_votes
from pickwise.sources.fixtures import f1

LR = ["rm_q", "rm_disc", "j80", "j70", "j60"]
LM = ["j80", "j70", "j60", "j_abstain"]
ORDER = ["j80", "j70", "j60", "rm_disc", "j_always"]


def _lr_data(spark, sf, src=None):
    d = src if src is not None else f1(spark, sf)
    return minmax_all(d.select("problem_id", "sample_idx", "y", *LR), LR)


@register("logistic")
def logistic(spark, sf):
    """Balanced L2 logistic regression (C = 1) on the normalised scores; coefficients."""
    p = logistic_fit(_lr_data(spark, sf), LR)
    return p.select(*[r6(c, c) for c in p.columns])


@register("logistic_select")
def logistic_select(spark, sf):
    d = _lr_data(spark, sf)
    s = logistic_score(d, logistic_fit(d, LR, logit_adjust=True), LR)
    return M.summary(M.problem_results(s).withColumn("set", F.lit("train")))


@register("logistic_per_problem")
def logistic_per_problem(spark, sf):
    """One model per problem (problems with both labels)."""
    d = _lr_data(spark, sf)
    p = logistic_fit(d, LR, group_col="problem_id")
    return p.select("problem_id", *[r6(c, c) for c in p.columns if c != "problem_id"])


def _dev_prior(spark, sf):
    """Class balance from the sparse dev labels (F1dev), the usual input of a label model."""
    from pickwise.models.simple import class_balance
    from pickwise.sources.fixtures import f1dev
    return class_balance(f1dev(spark, sf), "dev").first()["class_balance"]


@register("label_model")
def label_model(spark, sf):
    """Class-conditional vote accuracies learned without labels; class balance from the dev labels."""
    votes = f1(spark, sf).select("problem_id", "sample_idx", "y", *LM)
    p = label_model_fit(votes, LM, _dev_prior(spark, sf))
    return p.select("verifier", *[r6(c, c) for c in p.columns if c != "verifier"])


@register("label_model_select")
def label_model_select(spark, sf):
    votes = f1(spark, sf).select("problem_id", "sample_idx", "y", *LM)
    s = label_model_score(votes, label_model_fit(votes, LM, _dev_prior(spark, sf)), LM)
    return M.summary(M.problem_results(s).withColumn("set", F.lit("train")))


def _tensor_sql(vs):
    import itertools
    pm = {v: f"CASE WHEN {v} = 1 THEN 1.0 WHEN {v} = 0 THEN -1.0 END" for v in vs}
    parts = []
    for i, j, k in itertools.combinations(range(len(vs)), 3):
        a, b, c = pm[vs[i]], pm[vs[j]], pm[vs[k]]
        both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL AND ({c}) IS NOT NULL"
        parts.append(f"""SELECT avg(CASE WHEN {both} THEN ({a}) * ({b}) END) AS ab, avg(CASE WHEN {both} THEN ({a}) * ({c}) END) AS ac,
  avg(CASE WHEN {both} THEN ({b}) * ({c}) END) AS bc, avg(CASE WHEN {both} THEN ({a}) * ({b}) * ({c}) END) AS abc FROM f1""")
    body = " UNION ALL ".join(parts)
    return f"""WITH m AS ({body}),
e AS (SELECT abc / (sqrt(abs(ab * ac / bc)) * sqrt(abs(ab * bc / ac)) * sqrt(abs(ac * bc / ab))) AS ey FROM m
      WHERE least(abs(ab), abs(ac), abs(bc)) >= 1e-12)
SELECT round(avg(least(1.0, greatest(0.0, (1.0 + ey) / 2.0))), 6) AS class_balance FROM e"""


@register("class_balance_tensor", sql=_tensor_sql(LM))
def class_balance_tensor_q(spark, sf):
    votes = f1(spark, sf).select("problem_id", "sample_idx", *LM)
    return class_balance_tensor(votes, LM).select(r6("class_balance", "class_balance"))


def _triplet_select_sql(vs):
    a, b, c = vs
    cov = lambda x, y: f"covar_samp({x}, {y})"
    m3 = f"({a} + {b} + {c}) / 3.0"
    var = f"avg((({a} - {m3}) * ({a} - {m3}) + ({b} - {m3}) * ({b} - {m3}) + ({c} - {m3}) * ({c} - {m3})) / 3.0)"
    return f"""WITH o AS (SELECT {cov(a, a)} AS c00, {cov(a, b)} AS c01, {cov(a, c)} AS c02, {cov(b, b)} AS c11,
                          {cov(b, c)} AS c12, {cov(c, c)} AS c22, {var} AS vy FROM f1),
t AS (SELECT *, sqrt(c01 * c02 * vy / c12) AS s0, sqrt(c01 * c12 * vy / c02) AS s1, sqrt(c02 * c12 * vy / c01) AS s2,
             c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02) AS det FROM o),
w AS (SELECT ((c11 * c22 - c12 * c12) * s0 + (c02 * c12 - c01 * c22) * s1 + (c01 * c12 - c02 * c11) * s2) / det AS w0,
             ((c02 * c12 - c01 * c22) * s0 + (c00 * c22 - c02 * c02) * s1 + (c01 * c02 - c00 * c12) * s2) / det AS w1,
             ((c01 * c12 - c02 * c11) * s0 + (c01 * c02 - c00 * c12) * s1 + (c00 * c11 - c01 * c01) * s2) / det AS w2 FROM t),
s AS (SELECT problem_id, sample_idx, y, {a} * w0 + {b} * w1 + {c} * w2 AS p1 FROM f1, w)
SELECT problem_id, CAST(sample_idx AS INT) AS top1_idx, CAST(y AS INT) AS top1_label, CAST(hp AS INT) AS has_positive,
  CAST(y = 1 AS INT) AS top1_positive, CAST(y = 1 AND hp = 1 AS INT) AS top1_tp, CAST(y = 1 AND hp = 0 AS INT) AS top1_fp,
  CAST(y = 0 AND hp = 0 AS INT) AS top1_tn, CAST(y = 0 AND hp = 1 AS INT) AS top1_fn
FROM (SELECT *, max(y) OVER (PARTITION BY problem_id) AS hp,
             row_number() OVER (PARTITION BY problem_id ORDER BY p1 DESC, sample_idx) AS rk FROM s) WHERE rk = 1"""


@register("oracle_logistic")
def oracle_logistic(spark, sf):
    d = _lr_data(spark, sf, f1(spark, sf))
    return SC.oracle_logistic(d, LR, [1, 2, 4]).select("k", r6("accuracy", "accuracy"))


@register("oracle_logistic_per_problem")
def oracle_logistic_per_problem(spark, sf):
    d = _lr_data(spark, sf, f1(spark, sf))
    return SC.oracle_logistic_per_problem(d, LR, [2, 4]).select("k", r6("accuracy", "accuracy"))


@register("label_model_at_k")
def label_model_at_k(spark, sf):
    votes = f1(spark, sf).select("problem_id", "sample_idx", "y", *LM)
    return SC.label_model_at_k(votes, LM, [2, 4]).select("k", r6("accuracy", "accuracy"))


VS = [int(v) for v in np.linspace(1, len(ORDER), 10).astype(int)]


def _matrix_sql(rs, vs, src):
    parts = []
    for r in rs:
        for v in sorted(set(vs)):
            ens = "(" + " + ".join(ORDER[:v]) + f") / {float(v)}"
            parts.append(f"""SELECT {r} AS r, {v} AS v, avg(y) AS accuracy FROM (
  SELECT y, row_number() OVER (PARTITION BY problem_id ORDER BY {ens} DESC, sample_idx) AS rk
  FROM {src} WHERE sample_idx < {r} AND problem_id IN (SELECT problem_id FROM {src} GROUP BY problem_id HAVING count(*) >= {r})) WHERE rk = 1""")
    body = " UNION ALL ".join(parts)
    grid = " UNION ALL ".join(f"SELECT {r} AS r, {v} AS v" for r in rs for v in vs)
    return f"SELECT g.r, g.v, round(m.accuracy, 6) AS accuracy FROM ({grid}) g JOIN ({body}) m ON g.r = m.r AND g.v = m.v"


@register("scaling_matrix", sql=_matrix_sql([1, 2, 3, 4], VS, "f1"))
def scaling_matrix(spark, sf):
    """Samples x verifiers grid (verifiers in a fixed order; duplicates of the linspace grid kept)."""
    m = SC.scaling_matrix(f1(spark, sf), ORDER, [1, 2, 3, 4], VS)
    return m.select("r", "v", r6("accuracy", "accuracy"))


def _vscale_sql(points=5):
    vs = [int(v) for v in np.linspace(1, len(ORDER), points).astype(int)]
    parts = []
    for v in vs:
        ens = "(" + " + ".join(ORDER[:v]) + f") / {float(v)}"
        parts.append(f"""SELECT {v} AS n_verifiers, round(avg(y), 6) AS accuracy FROM (
  SELECT y, row_number() OVER (PARTITION BY problem_id ORDER BY {ens} DESC, sample_idx) AS rk FROM f1) WHERE rk = 1""")
    return " UNION ALL ".join(parts)


@register("verifier_scaling", sql=_vscale_sql())
def verifier_scaling(spark, sf):
    m = SC.verifier_scaling(f1(spark, sf), ORDER, 5)
    return m.select("n_verifiers", r6("accuracy", "accuracy"))


def _vscale_best_sql(points=5):
    vs = ORDER
    top = " UNION ALL ".join(
        f"SELECT '{v}' AS verifier, {i} AS pos, y FROM (SELECT y, row_number() OVER (PARTITION BY problem_id "
        f"ORDER BY {v} DESC NULLS LAST, sample_idx) AS rk FROM f1) WHERE rk = 1" for i, v in enumerate(vs))
    pick = lambda r: ("CASE (SELECT verifier FROM rk WHERE r = " + str(r) + ") " +  # noqa: E731
                      " ".join(f"WHEN '{v}' THEN {v}" for v in vs) + " END")
    cols = ", ".join(f"{pick(r)} AS s{r}" for r in range(1, len(vs) + 1))
    parts = []
    for v in [int(x) for x in np.linspace(1, len(vs), points).astype(int)]:
        ens = "(" + " + ".join(f"s{r}" for r in range(1, v + 1)) + f") / {float(v)}"
        parts.append(f"""SELECT {v} AS n_verifiers, round(avg(y), 6) AS accuracy FROM (
  SELECT y, row_number() OVER (PARTITION BY problem_id ORDER BY {ens} DESC, sample_idx) AS rk2 FROM sv) WHERE rk2 = 1""")
    return f"""WITH t AS ({top}), acc AS (SELECT verifier, pos, avg(y) AS a FROM t GROUP BY verifier, pos),
rk AS (SELECT verifier, row_number() OVER (ORDER BY a DESC, pos) AS r FROM acc),
sv AS (SELECT problem_id, sample_idx, y, {cols} FROM f1)
{" UNION ALL ".join(parts)}"""


@register("verifier_scaling_best", sql=_vscale_best_sql())
def verifier_scaling_best(spark, sf):
    """Verifiers ordered best first by their own top-1 accuracy (order found by Spark)."""
    d = f1(spark, sf)
    order = SC.verifier_order(d, ORDER, "best")
    return SC.verifier_scaling(d, order, 5).select("n_verifiers", r6("accuracy", "accuracy"))


def _curve_sql(order, ks, b, seed=42):
    ens = "(" + " + ".join(order) + f") / {float(len(order))}"
    md5 = (f"md5(concat_ws('|', '{seed}', CAST(draw AS VARCHAR), CAST(problem_id AS VARCHAR), "
           f"CAST(sample_idx AS VARCHAR)))")
    firsts = ", ".join(f"max(CASE WHEN r_{v} = 1 THEN y END) AS v_{v}" for v in order)
    ranks = ", ".join(f"row_number() OVER (PARTITION BY k, draw, problem_id ORDER BY {v} DESC, sample_idx) AS r_{v}"
                      for v in order)
    avgs = ", ".join(f"avg(v_{v}) AS v_{v}" for v in order)
    best = "greatest(" + ", ".join(f"v_{v}" for v in order) + ")"
    methods = []
    for m, e in (("pass_at_k", "pass_at_k"), ("ensemble", "ensemble"), ("best_verifier", "best_verifier"),
                 ("majority", "majority")):
        methods.append(f"SELECT '{m}' AS method, k, round(avg({e}), 6) AS mean, round(stddev_pop({e}), 6) AS sd FROM d GROUP BY k")
    return f"""WITH n AS (SELECT problem_id, count(*) AS n FROM f1 GROUP BY problem_id),
rep AS (SELECT f.*, CAST(dr AS INT) AS draw, CAST(kk AS INT) AS k FROM f1 f JOIN n ON f.problem_id = n.problem_id,
        (SELECT unnest(range({b})) AS dr), (SELECT unnest({list(ks)}) AS kk) WHERE n.n >= kk),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, draw, problem_id ORDER BY {md5}) AS slot FROM rep) WHERE slot <= k),
rk AS (SELECT *, row_number() OVER (PARTITION BY k, draw, problem_id ORDER BY {ens} DESC, sample_idx) AS r_ens, {ranks} FROM bs),
per AS (SELECT k, draw, problem_id, max(y) AS pass, max(CASE WHEN r_ens = 1 THEN y END) AS ens, {firsts} FROM rk GROUP BY k, draw, problem_id),
bd AS (SELECT k, draw, avg(pass) AS pass_at_k, avg(ens) AS ensemble, {avgs} FROM per GROUP BY k, draw),
a AS (SELECT k, draw, problem_id, answer, count(*) AS cnt, sum(y) AS nc, min(sample_idx) AS first_idx FROM bs
      WHERE answer IS DISTINCT FROM 'NO_ANSWER' GROUP BY k, draw, problem_id, answer),
mv AS (SELECT k, draw, avg(CASE WHEN nc > cnt / 2.0 THEN 1 ELSE 0 END) AS majority FROM (
         SELECT *, row_number() OVER (PARTITION BY k, draw, problem_id ORDER BY cnt DESC, first_idx) AS rr FROM a) WHERE rr = 1
       GROUP BY k, draw),
d AS (SELECT bd.*, {best} AS best_verifier, mv.majority FROM bd JOIN mv ON bd.k = mv.k AND bd.draw = mv.draw)
{" UNION ALL ".join(methods)}"""


@register("scaling_curve", sql=_curve_sql(ORDER, [1, 2, 4], 4))
def scaling_curve(spark, sf):
    m = SC.scaling_curve(f1(spark, sf), ORDER, [1, 2, 4], 4, 42, methods=("pass_at_k", "ensemble", "best_verifier", "majority"))
    return m.select("method", "k", r6("mean", "mean"), r6("sd", "sd"))


@register("scaling_curve_fits")
def scaling_curve_fits(spark, sf):
    """Logistic regression and both label models over the same draws."""
    m = SC.scaling_curve(f1(spark, sf), ORDER[:4], [1, 2, 4], 3, 42, methods=("logistic", "label_model", "continuous"), class_balance=0.5)
    return m.select("method", "k", r6("mean", "mean"), r6("sd", "sd"))


@register("oracle_logistic_split")
def oracle_logistic_split(spark, sf):
    """The first four fifths of the rows teach."""
    d = _lr_data(spark, sf, f1(spark, sf))
    return SC.oracle_logistic(d, LR, [1, 2, 4], 0.8).select("k", r6("accuracy", "accuracy"))


@register("scaling_heatmap")
def scaling_heatmap(spark, sf):
    d = f1(spark, sf)
    m = SC.scaling_heatmap(d, d, ["j80", "j70", "j60", "j_abstain"], [2, 4], [1, 3, 4])
    return m.select("method", "r", "v", r6("accuracy", "accuracy"))


@register("power_law_fit")
def power_law_fit(spark, sf):
    """a * k^b + c fitted to the unbiased pass@k curve (k = 1..8) and the selection@k curve."""
    d = f1(spark, sf)
    ks = list(range(1, 9))
    pk = M.pass_at_k_unbiased(d, ks).select(F.lit("pass_at_k").alias("series"), F.col("k").cast("double").alias("x"),
                                            F.col("pass_at_k").alias("y"))
    sk = M.selection_at_k(d, "rm_q", ks).select(F.lit("selection_rm_q").alias("series"),
                                                F.col("k").cast("double").alias("x"), F.col("accuracy").alias("y"))
    fit = SC.power_law_fit(pk.unionByName(sk))
    return fit.select("series", *[r6(c, c) for c in ("a", "b", "c", "r2")])


@register("gaussian_em")
def gaussian_em(spark, sf):
    """Per difficulty bin (4 bins): incorrect / correct Gaussian score model started from the
    labels, covariance ridge 0.01; selection summary with p1 = P(correct | scores)."""
    from pickwise.models.gaussian import gaussian_em as fit_score
    from pickwise.operators.sampling import difficulty_bins

    d = _lr_data(spark, sf)
    bins = difficulty_bins(d, 4).select("problem_id", "difficulty")
    s = fit_score(d.join(bins, "problem_id"), LR, group_col="difficulty")
    return M.summary(M.problem_results(s).withColumn("set", F.lit("train")))


@register("mixture_logistic")
def mixture_logistic(spark, sf):
    """Three logistic experts with a softmax gate on per-problem score statistics (EM);
    selection summary with the gate-weighted p1."""
    from pickwise.models.mixture import mixture_fit, mixture_score

    d = _lr_data(spark, sf)
    model = mixture_fit(d, LR, k=3, max_iter=10)
    s = mixture_score(d, model)
    return M.summary(M.problem_results(s).withColumn("set", F.lit("train")))


CONFIGURED = ["rm_q", "rm_disc", "j80", "j70", "j60"]


def _run_sql(vs, grouped: bool) -> str:
    """CTEs of a naive Bayes run on the 80 / 20 split: one model, or one per third of the problems by difficulty."""
    fill = ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in vs)
    bucket = (f"clu AS (SELECT problem_id, {_split_bucket_sql('pos', 'n', 3)} AS g FROM (SELECT problem_id, row_number() OVER (ORDER BY m, problem_id) - 1 AS pos, "
              "count(*) OVER () AS n FROM (SELECT problem_id, avg(y) AS m FROM f1 GROUP BY problem_id)))" if grouped
              else "clu AS (SELECT DISTINCT problem_id, 0 AS g FROM f1)")
    keep = ("problem_id", "sample_idx", "y", "g")
    return (f"n AS ({Q.minmax_all('f1', vs)}), nf AS (SELECT problem_id, sample_idx, y, {fill} FROM n), b0 AS ({Q.binarize('nf', vs)}), "
            f"{_split_sql()}, {bucket}, b AS (SELECT b0.*, clu.g FROM b0 JOIN clu USING (problem_id)), "
            f"prm AS (SELECT g AS pg, {Q.nb_params('b', vs).removeprefix('SELECT ').removesuffix(' FROM b')} FROM b JOIN split USING (problem_id) WHERE split.set = 'train' GROUP BY g), "
            f"s AS ({Q.nb_p1('b', 'prm', vs, keep)} WHERE b.g = prm.pg), t AS ({Q.top1('s')}), sm AS ({Q.sample_metrics('s')}), "
            "res AS (SELECT split.set, split.difficulty, t.*, sm.* EXCLUDE (problem_id), clu.g FROM t JOIN sm USING (problem_id) JOIN split USING (problem_id) JOIN clu USING (problem_id))")


@register("selection_run", sql=f"WITH {_run_sql(CONFIGURED, False)} {Q.summary('res')}")
def selection_run(spark, sf):
    """The configurable run: 80 / 20 stratified split, naive Bayes fitted on train, summary per set."""
    from pickwise.plans.selection import run_selection

    _, summ, _ = run_selection(f1(spark, sf), CONFIGURED, "naive_bayes", 0.8)
    return summ


@register("selection_run_by_difficulty")
def selection_run_by_difficulty(spark, sf):
    from pickwise.plans.selection import run_selection

    _, _, by_diff = run_selection(f1(spark, sf), ["rm_q", "rm_disc", "j80", "j70", "j60"], "label_model", 0.8)
    return by_diff


@register("selection_run_cluster", sql=f"""WITH {_run_sql(CONFIGURED, True)}
SELECT set, problem_id, difficulty, top1_idx, top1_positive, sample_accuracy, CAST(g AS BIGINT) AS model_id FROM res""")
def selection_run_cluster(spark, sf):
    """Naive Bayes per difficulty cluster, 80 / 20 split; every problem with the model it used."""
    from pickwise.plans.selection import RunConfig, run

    results, _, _ = run(f1(spark, sf, persist=False), CONFIGURED, RunConfig(model_class="cluster", n_clusters=3, train_split=0.8))
    return results.select("set", "problem_id", "difficulty", "top1_idx", "top1_positive", "sample_accuracy", "model_id")


@register("selection_run_per_problem")
def selection_run_per_problem(spark, sf):
    """Naive Bayes per problem; test problems use the nearest trained problem's model."""
    from pickwise.plans.selection import RunConfig, run

    results, _, _ = run(f1(spark, sf), CONFIGURED, RunConfig(model_class="per_problem", train_split=0.8))
    return results


@register("selection_run_class_balance")
def selection_run_class_balance(spark, sf):
    """Votes at the class-balance thresholds, majority vote as a verifier, unbalanced verifiers dropped."""
    from pickwise.plans.selection import RunConfig, run

    cfg = RunConfig(binarize="class_balance", missing="mean", majority_as_verifier=True, drop_imbalanced="all", train_split=0.8)
    _, summ, _ = run(f1(spark, sf), CONFIGURED, cfg)
    return summ


@register("selection_run_winsorized_labels")
def selection_run_winsorized_labels(spark, sf):
    """Label model per cluster on winsorized scores with the labels' class balance."""
    from pickwise.plans.selection import RunConfig, run

    cfg = RunConfig(model="label_model", model_class="cluster", normalize="winsorize", class_balance="labels")
    _, summ, _ = run(f1(spark, sf), CONFIGURED, cfg)
    return summ
