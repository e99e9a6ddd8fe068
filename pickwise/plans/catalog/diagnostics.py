"""Catalog: verifier diagnostics (ops 119-130)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions.columns import r6, sum_cols
from pickwise.operators import diagnostics as D
from pickwise.operators.scores import minmax_all
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.registry import register
from pickwise.sources.fixtures import F1_CLEAN_JUDGES, f1

DV = ["rm_q", "rm_disc", "j80", "j70", "j60"]
NORM = f"n AS ({Q.minmax_all('f1', DV)})"


def _norm(spark, sf):
    return minmax_all(f1(spark, sf).select("problem_id", "sample_idx", "y", *DV), DV)


def _long_sql(src="n"):
    return " UNION ALL ".join(f"SELECT problem_id, sample_idx, y, '{v}' AS verifier, {i} AS pos, {v} AS score FROM {src}"
                              for i, v in enumerate(DV))


def _pv(df):
    return df.select("problem_id", "verifier", r6("value", "value"))


@register("verifier_selection_matrix", sql=f"""WITH {NORM}, lg AS ({_long_sql()})
SELECT problem_id, verifier, CAST(y AS INT) AS value FROM lg
QUALIFY row_number() OVER (PARTITION BY problem_id, verifier ORDER BY score DESC NULLS LAST, sample_idx) = 1""")
def verifier_selection_matrix(spark, sf):
    return D.verifier_selection_matrix(_norm(spark, sf), DV)


@register("verifier_accuracy_matrix", sql=f"""WITH {NORM}, lg AS ({_long_sql()})
SELECT problem_id, verifier, round(avg(CAST(CAST(score >= 0.5 AS INT) = y AS DOUBLE)), 6) AS value FROM lg GROUP BY problem_id, verifier""")
def verifier_accuracy_matrix(spark, sf):
    return _pv(D.verifier_accuracy_matrix(_norm(spark, sf), DV))


@register("verifier_accuracy_variance", sql=f"""WITH {NORM}, lg AS ({_long_sql()})
SELECT problem_id, verifier, round(var_pop(CAST(CAST(score >= 0.5 AS INT) = y AS DOUBLE)), 6) AS value FROM lg GROUP BY problem_id, verifier""")
def verifier_accuracy_variance(spark, sf):
    return _pv(D.verifier_accuracy_variance(_norm(spark, sf), DV))


@register("score_variance", sql=f"""WITH {NORM}, lg AS ({_long_sql()})
SELECT problem_id, verifier, round(var_pop(score), 6) AS value FROM lg GROUP BY problem_id, verifier""")
def score_variance(spark, sf):
    return _pv(D.score_variance(_norm(spark, sf), DV))


@register("precision_matrix")
def precision_matrix(spark, sf):
    """Covariance, precision and partial correlation of the normalised scores; rows-only
    (the covariance part is checked by ``gram``)."""
    return D.precision_matrix(_norm(spark, sf), DV)


def _pcorr_sql(vs):
    a, b, c = vs
    names = [a, b, c]
    adj = {(0, 0): "c11 * c22 - c12 * c12", (1, 1): "c00 * c22 - c02 * c02", (2, 2): "c00 * c11 - c01 * c01",
           (0, 1): "c02 * c12 - c01 * c22", (0, 2): "c01 * c12 - c02 * c11", (1, 2): "c01 * c02 - c00 * c12"}
    rows = []
    for i in range(3):
        for j in range(3):
            if i == j:
                expr = "1.0"
            else:
                key = (min(i, j), max(i, j))
                expr = f"-({adj[key]}) / sqrt(({adj[(i, i)]}) * ({adj[(j, j)]}))"
            rows.append(f"SELECT '{names[i]}' AS vi, '{names[j]}' AS vj, round({expr}, 6) AS partial_corr FROM o")
    return (f"WITH o AS (SELECT covar_samp({a}, {a}) AS c00, covar_samp({a}, {b}) AS c01, covar_samp({a}, {c}) AS c02, "
            f"covar_samp({b}, {b}) AS c11, covar_samp({b}, {c}) AS c12, covar_samp({c}, {c}) AS c22 FROM f1) "
            + " UNION ALL ".join(rows))


@register("partial_correlation", sql=_pcorr_sql(F1_CLEAN_JUDGES))
def partial_correlation(spark, sf):
    p = D.precision_matrix(f1(spark, sf), F1_CLEAN_JUDGES)
    return p.select("vi", "vj", r6("partial_corr", "partial_corr"))


@register("class_distribution", sql="""SELECT CAST(least(floor(pos * 20), 19) AS INT) AS bin, count(*) AS n_problems
FROM (SELECT problem_id, avg(y) AS pos FROM f1 GROUP BY problem_id) GROUP BY 1""")
def class_distribution(spark, sf):
    return D.class_distribution(f1(spark, sf), 20)


@register("class_quartiles", sql="""SELECT round(quantile_cont(pos, 0.25), 6) AS q25, round(quantile_cont(pos, 0.5), 6) AS q50,
       round(quantile_cont(pos, 0.75), 6) AS q75 FROM (SELECT problem_id, avg(y) AS pos FROM f1 GROUP BY problem_id)""")
def class_quartiles(spark, sf):
    q = D.class_quartiles(f1(spark, sf))
    return q.select(*[r6(c, c) for c in q.columns])


@register("ensemble_variance", sql=f"""WITH {NORM}, lg AS ({_long_sql()}),
acc AS (SELECT verifier, pos, avg(a) AS acc FROM (SELECT problem_id, verifier, pos, avg(CAST(CAST(score >= 0.5 AS INT) = y AS DOUBLE)) AS a
        FROM lg GROUP BY problem_id, verifier, pos) GROUP BY verifier, pos),
rk AS (SELECT verifier, row_number() OVER (ORDER BY acc DESC, pos DESC) AS r FROM acc),
pm AS (SELECT problem_id, verifier, avg(score) AS m FROM lg GROUP BY problem_id, verifier),
ks AS (SELECT unnest(range(1, {len(DV) + 1})) AS k),
pk AS (SELECT k, problem_id, avg(m) AS p FROM pm JOIN rk USING (verifier), ks WHERE r <= k GROUP BY k, problem_id),
v AS (SELECT CAST(k AS INT) AS k, avg(p * (1 - p)) AS variance FROM pk GROUP BY k)
SELECT k, round(variance, 6) AS variance, k = (SELECT arg_min(k, variance) FROM v) AS is_min FROM v""")
def ensemble_variance(spark, sf):
    e = D.ensemble_variance(_norm(spark, sf), DV)
    return e.select(F.col("k").cast("int").alias("k"), r6("variance", "variance"), "is_min")


# per-problem means compared with 0.5: 0/1 judges keep those means exact in every engine
AV = ["j80", "j70", "j60", "j_always"]


def _pm_sql():
    return f"pm AS (SELECT problem_id, {', '.join(f'avg({v}) AS {v}' for v in AV)} FROM f1 GROUP BY problem_id)"


@register("agreement_matrix", sql=f"""WITH {_pm_sql()}
{' UNION ALL '.join(f"SELECT '{a}' AS vi, '{b}' AS vj, round(avg(CAST(({a} > 0.5) = ({b} > 0.5) AS DOUBLE)), 6) AS agreement FROM pm" for a in AV for b in AV)}""")
def agreement_matrix(spark, sf):
    a = D.agreement_matrix(f1(spark, sf), AV)
    return a.select("vi", "vj", r6("agreement", "agreement"))


@register("vote_margin", sql=f"""WITH {_pm_sql()},
vv AS (SELECT {' + '.join(f'CAST({v} > 0.5 AS INT)' for v in AV)} AS votes FROM pm)
SELECT CAST(abs(votes - ({len(AV)} - votes)) AS INT) AS margin, count(*) AS n_problems FROM vv GROUP BY 1""")
def vote_margin(spark, sf):
    v = D.vote_margin(f1(spark, sf), AV)
    return v.select(F.col("margin").cast("int").alias("margin"), "n_problems")


ENS_SQL = "(j80 + j70 + j60) / 3.0"


def _ens(spark, sf):
    return f1(spark, sf).withColumn("p1", sum_cols(F1_CLEAN_JUDGES) / F.lit(3.0))


_NLL = ("-(y * ln(least(greatest(p1, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p1, 1e-6), 1 - 1e-6)))")
_ENT = "-(least(greatest(m, 1e-6), 1 - 1e-6) * ln(least(greatest(m, 1e-6), 1 - 1e-6)) + (1 - least(greatest(m, 1e-6), 1 - 1e-6)) * ln(1 - least(greatest(m, 1e-6), 1 - 1e-6)))"


@register("likelihood_gain", sql=f"""WITH s AS (SELECT problem_id, sample_idx, y, {ENS_SQL} AS p1 FROM f1),
m AS (SELECT problem_id, avg(y) AS m FROM s GROUP BY problem_id)
SELECT round(avg({_NLL}), 6) AS nll, round(avg({_NLL} - {_ENT}), 6) AS gain FROM s JOIN m USING (problem_id)""")
def likelihood_gain(spark, sf):
    g = D.likelihood_gain(_ens(spark, sf))
    return g.select(r6("nll", "nll"), r6("gain", "gain"))


@register("top_nll", sql=f"""WITH s AS (SELECT problem_id, sample_idx, y, {ENS_SQL} AS p1 FROM f1),
m AS (SELECT problem_id, avg(y) AS m FROM s GROUP BY problem_id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY p1 DESC, sample_idx) = 1)
SELECT round(avg({_NLL}), 6) AS top_nll, round(avg({_NLL} - {_ENT}), 6) AS top_gain FROM t JOIN m USING (problem_id)""")
def top_nll(spark, sf):
    g = D.top_nll(_ens(spark, sf))
    return g.select(r6("top_nll", "top_nll"), r6("top_gain", "top_gain"))
