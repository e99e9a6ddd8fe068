"""Catalog: aggregation models (ops 77-90)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.models import moments as MO
from pickwise.models.naive_bayes import nb_fit, nb_score
from pickwise.models.simple import class_balance, naive_ensemble
from pickwise.operators import metrics as M
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.registry import register
from pickwise.plans.selection import weak_votes
from pickwise.sources.fixtures import F1_CLEAN_JUDGES, f1, f1dev

FLAG = ["rm_q", "rm_price", "rm_disc", "rm_null", "j80", "j70", "j60", "j_always"]
IDS = ["problem_id", "sample_idx"]


def _votes_sql(vs):
    fill = ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in vs)
    return (f"n AS ({Q.minmax_all('f1', vs)}), nf AS (SELECT problem_id, sample_idx, y, {fill} FROM n), "
            f"b AS ({Q.binarize('nf', vs)})")


@register("first_sample", sql="""SELECT problem_id, CAST(max(CASE WHEN sample_idx = 0 THEN y END) AS INT) AS top1_positive,
  count_if(y = 1) AS sample_tp, count_if(y = 0) AS sample_tn FROM f1 GROUP BY problem_id""")
def first_sample(spark, sf):
    return M.first_sample(f1(spark, sf))


@register("coverage", sql="SELECT problem_id, CAST(max(y) AS INT) AS coverage FROM f1 GROUP BY problem_id")
def coverage(spark, sf):
    return M.coverage(f1(spark, sf))


ENS4 = ["j80", "j70", "j60", "rm_disc"]


@register("naive_ensemble", sql="SELECT problem_id, sample_idx, round((j80 + j70 + j60 + rm_disc) / 4.0, 6) AS p1 FROM f1")
def naive_ensemble_q(spark, sf):
    d = naive_ensemble(f1(spark, sf), ENS4)
    return d.select(*IDS, r6("p1", "p1"))


@register("naive_bayes", sql=f"WITH {_votes_sql(FLAG)}, prm AS ({Q.nb_params('b', FLAG)}), s AS ({Q.nb_p1('b', 'prm', FLAG)}) "
          "SELECT problem_id, sample_idx, round(p1, 6) AS p1 FROM s")
def naive_bayes(spark, sf):
    votes = weak_votes(f1(spark, sf), FLAG)
    s = nb_score(votes, nb_fit(votes, FLAG), FLAG)
    return s.select(*IDS, r6("p1", "p1"))


def _sql_accs(vs):
    parts = [f"SELECT '{v}' AS verifier, round({v}__tpr, 6) AS p_s1_y1, round({v}__tnr, 6) AS p_s0_y0, "
             f"round(1 - {v}__tnr, 6) AS p_s1_y0, round(1 - {v}__tpr, 6) AS p_s0_y1 FROM prm" for v in vs]
    return " UNION ALL ".join(parts)


def verifier_accuracies(params: DataFrame, verifiers) -> DataFrame:
    """Long table of the class-conditional vote probabilities of a fitted naive Bayes model."""
    rows = [params.select(F.lit(v).alias("verifier"), F.col(f"{v}__tpr").alias("p_s1_y1"),
                          F.col(f"{v}__tnr").alias("p_s0_y0"), (F.lit(1.0) - F.col(f"{v}__tnr")).alias("p_s1_y0"),
                          (F.lit(1.0) - F.col(f"{v}__tpr")).alias("p_s0_y1")) for v in verifiers]
    return reduce(DataFrame.unionByName, rows)


@register("verifier_accuracies", sql=f"WITH {_votes_sql(FLAG)}, prm AS ({Q.nb_params('b', FLAG)}) {_sql_accs(FLAG)}")
def verifier_accuracies_q(spark, sf):
    votes = weak_votes(f1(spark, sf), FLAG)
    acc = verifier_accuracies(nb_fit(votes, FLAG), FLAG)
    return acc.select("verifier", *[r6(c, c) for c in acc.columns[1:]])


@register("verifier_ranking", sql=f"""WITH {_votes_sql(FLAG)}, prm AS ({Q.nb_params('b', FLAG)}), a AS ({_sql_accs(FLAG).replace("round(", "(").replace(", 6)", ")")})
SELECT verifier, round(0.5 * (p_s1_y1 + p_s0_y0), 6) AS balanced_accuracy,
       CAST(row_number() OVER (ORDER BY 0.5 * (p_s1_y1 + p_s0_y0) DESC, verifier) AS INT) AS rank FROM a""")
def verifier_ranking(spark, sf):
    from pickwise.operators.verifiers import verifier_ranking as rank_op
    votes = weak_votes(f1(spark, sf), FLAG)
    acc = verifier_accuracies(nb_fit(votes, FLAG), FLAG)
    return rank_op(acc).select("verifier", r6("balanced_accuracy", "balanced_accuracy"), "rank")


@register("naive_bayes_per_problem", sql=f"""WITH {_votes_sql(FLAG)},
prm AS (SELECT problem_id, {Q.nb_params('b', FLAG).split('SELECT ', 1)[1].rsplit(' FROM ', 1)[0]}, count(DISTINCT y) AS nl
        FROM b GROUP BY problem_id HAVING count(DISTINCT y) = 2),
s AS (SELECT b.problem_id, b.sample_idx, b.y, 1.0 / (1.0 + exp(-((
      {' + '.join(f"ln({v} * {v}__tpr + (1 - {v}) * (1 - {v}__tpr))" for v in FLAG)} + ln(cb)) - (
      {' + '.join(f"ln({v} * (1 - {v}__tnr) + (1 - {v}) * {v}__tnr)" for v in FLAG)} + ln(1 - cb))))) AS p1
      FROM b JOIN prm ON b.problem_id = prm.problem_id)
SELECT problem_id, sample_idx, round(p1, 6) AS p1 FROM s""")
def naive_bayes_per_problem(spark, sf):
    """One naive Bayes model per problem (TPR/TNR clipped to [0, 1] as configured; log 0 = -inf).

    Problems with a single label value are skipped, as the reference does."""
    votes = weak_votes(f1(spark, sf), FLAG)
    s = nb_score(votes, nb_fit(votes, FLAG, group_col="problem_id"), FLAG, group_col="problem_id")
    return s.select(*IDS, r6("p1", "p1"))


@register("class_balance", sql="SELECT round(avg(CAST(y AS DOUBLE)), 6) AS class_balance FROM f1")
def class_balance_q(spark, sf):
    return class_balance(f1(spark, sf)).select(r6("class_balance", "class_balance"))


@register("class_balance_dev", fixtures=("f1dev",),
          sql="SELECT round(avg(CAST(dev_label AS DOUBLE)), 6) AS class_balance FROM f1dev")
def class_balance_dev(spark, sf):
    return class_balance(f1dev(spark, sf), "dev").select(r6("class_balance", "class_balance"))


GRAM = ["j80", "j70", "j60", "j_abstain"]


def _sql_gram(vs):
    parts = []
    for a in vs:
        for b in vs:
            parts.append(f"SELECT '{a}' AS vi, '{b}' AS vj, count(*) AS n, round(avg({a} * {b}), 6) AS m2, "
                         f"round(covar_samp({a}, {b}), 6) AS cov FROM f1")
    return " UNION ALL ".join(parts)


@register("gram", sql=_sql_gram(GRAM))
def gram_q(spark, sf):
    g = MO.gram(f1(spark, sf), GRAM)
    return g.select("vi", "vj", "n", r6("m2", "m2"), r6("cov", "cov"))


@register("gram_wide", sql=_sql_gram(GRAM))
def gram_wide_q(spark, sf):
    g = MO.gram(f1(spark, sf), GRAM, wide_limit=2)  # the mapInPandas partial-Gram path
    return g.select("vi", "vj", "n", r6("m2", "m2"), r6("cov", "cov"))


def _sql_triplet(vs):
    a, b, c = vs
    o = lambda x, y: f"avg({x} * {y})"
    var = (f"avg((({a} - ({a} + {b} + {c}) / 3.0) ^ 2 + ({b} - ({a} + {b} + {c}) / 3.0) ^ 2 "
           f"+ ({c} - ({a} + {b} + {c}) / 3.0) ^ 2) / 3.0)")
    return f"""WITH m AS (SELECT {o(a, b)} AS oab, {o(a, c)} AS oac, {o(b, c)} AS obc, {var} AS var_y FROM f1)
SELECT '{a}' AS verifier, round(sqrt(oab * oac * var_y / obc), 6) AS cov_y, round(var_y, 6) AS var_y FROM m
UNION ALL SELECT '{b}', round(sqrt(oab * obc * var_y / oac), 6), round(var_y, 6) FROM m
UNION ALL SELECT '{c}', round(sqrt(oac * obc * var_y / oab), 6), round(var_y, 6) FROM m"""


@register("triplet_model", sql=_sql_triplet(F1_CLEAN_JUDGES))
def triplet_model(spark, sf):
    p = MO.triplet_fit(f1(spark, sf), F1_CLEAN_JUDGES)
    return p.select("verifier", r6("cov_y", "cov_y"), r6("var_y", "var_y"))


from pickwise.plans.catalog.fitted import _triplet_select_sql  # noqa: E402


@register("triplet_model_select", sql=_triplet_select_sql(F1_CLEAN_JUDGES))
def triplet_model_select(spark, sf):
    """Top-1 selection with the centred triplet model (Q35): covariance moments, triplet
    closed form for cov(v, y), weights O^-1 cov, p1 = w . x."""
    d = f1(spark, sf)
    p = MO.triplet_fit(d, F1_CLEAN_JUDGES, center=True)
    s = MO.triplet_score(d, p, F1_CLEAN_JUDGES)
    return M.select_top1(s)
