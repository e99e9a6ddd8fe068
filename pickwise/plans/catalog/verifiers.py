"""Catalog: choosing verifiers (ops 22-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.operators import verifiers as VR
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.registry import register
from pickwise.plans.selection import weak_votes
from pickwise.sources.fixtures import F1_VERIFIERS, f1
from pickwise.sources.tables import melt_scores

IDS = ["problem_id", "sample_idx"]

# Registry of the F1 verifiers (fixed metadata: kind and size in billions of parameters).
REGISTRY = [("rm_q", "reward_model", 8.0, "open"), ("rm_price", "reward_model", 70.0, "open"),
            ("rm_disc", "reward_model", 27.0, "open"), ("rm_null", "reward_model", None, "open"),
            ("j80", "judge", 70.0, "api"), ("j70", "judge", 8.0, "open"), ("j60", "judge", 3.0, "open"),
            ("j_abstain", "judge", 32.0, "api"), ("j_always", "judge", None, "api"),
            ("rm_q_step", "reward_model", 8.0, "open")]
REG_SQL = ("reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{k}', {'NULL' if s is None else s}::DOUBLE, '{a}')" for n, k, s, a in REGISTRY)
    + ") t(name, kind, num_parameters, access_type))")


def _registry(spark):
    return spark.createDataFrame(REGISTRY, "name string, kind string, num_parameters double, access_type string")


def _melt_sql(vs):
    return " UNION ALL ".join(f"SELECT problem_id, sample_idx, '{v}' AS verifier, {v} AS score FROM f1" for v in vs)


def _choose(kind, size, where):
    return f"""WITH {REG_SQL}, lg AS ({_melt_sql(F1_VERIFIERS)})
SELECT problem_id, sample_idx, verifier, round(score, 6) AS score FROM lg
WHERE verifier IN (SELECT name FROM reg WHERE {where} AND name NOT LIKE '%\\_step%' ESCAPE '\\')"""


def _q_choose(kind, size):
    def build(spark, sf):
        long = melt_scores(f1(spark, sf), F1_VERIFIERS)
        out = VR.choose_verifiers(long, _registry(spark), kind, size)
        return out.select(*IDS, "verifier", r6("score", "score"))
    return build


register("choose_verifiers", sql=_choose("judges", "small", "kind = 'judge' AND num_parameters IS NOT NULL AND num_parameters <= 8"))(
    _q_choose("judges", "small"))
register("choose_verifiers_medium", sql=_choose("all", "medium", "num_parameters IS NOT NULL AND num_parameters > 8 AND num_parameters < 32"))(
    _q_choose("all", "medium"))
register("choose_verifiers_reward_large", sql=_choose("reward_models", "large", "kind = 'reward_model' AND num_parameters IS NOT NULL AND num_parameters >= 32"))(
    _q_choose("reward_models", "large"))


@register("drop_empty", sql="""WITH d AS (SELECT problem_id, sample_idx, CASE WHEN sample_idx >= 3 THEN j80 END AS late FROM f1)
SELECT problem_id, sample_idx, late FROM d WHERE problem_id IN (SELECT problem_id FROM d GROUP BY problem_id HAVING count(late) > 0)""")
def drop_empty(spark, sf):
    """``late`` exists only from the fourth sample on and ``nothing`` never: the empty verifier
    is dropped, then problems with fewer than four samples (all missing) are dropped."""
    d = f1(spark, sf).select(*IDS, F.when(F.col("sample_idx") >= 3, F.col("j80")).alias("late"),
                             F.lit(None).cast("double").alias("nothing"))
    out, keep = VR.drop_empty(d, ["late", "nothing"])
    return out.select(*IDS, *keep)


FLAG = ["rm_q", "rm_price", "rm_disc", "rm_null", "j80", "j70", "j60", "j_always", "j_abstain"]


def _votes_sql(vs):
    fill = ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in vs)
    return (f"n AS ({Q.minmax_all('f1', vs)}), nf AS (SELECT problem_id, sample_idx, y, {fill} FROM n), "
            f"b AS ({Q.binarize('nf', vs)})")


def _marg_sql(vs):
    return " UNION ALL ".join(
        f"SELECT '{v}' AS verifier, avg({v}) AS mean, avg(CAST({v} = 1 AS DOUBLE)) AS p_pos, "
        f"avg(CAST({v} = 0 AS DOUBLE)) AS p_neg, avg(CAST({v} = -1 AS DOUBLE)) AS p_abstain FROM b" for v in vs)


@register("vote_marginals", sql=f"""WITH {_votes_sql(FLAG)}, m AS ({_marg_sql(FLAG)})
SELECT verifier, round(mean, 6) AS mean, round(p_pos, 6) AS p_pos, round(p_neg, 6) AS p_neg, round(p_abstain, 6) AS p_abstain FROM m""")
def vote_marginals(spark, sf):
    m = VR.vote_marginals(weak_votes(f1(spark, sf), FLAG), FLAG)
    return m.select("verifier", *[r6(c, c) for c in ("mean", "p_pos", "p_neg", "p_abstain")])


def _drop_sql(rule_cond, rule):
    return f"""WITH {_votes_sql(FLAG)}, m AS ({_marg_sql(FLAG)})
SELECT verifier, round(p_pos, 6) AS p_pos, round(p_neg, 6) AS p_neg, round(p_abstain, 6) AS p_abstain, '{rule}' AS rule,
       ({rule_cond}) AND p_abstain < 0.9 AND p_neg < 0.9 AND p_pos < 0.9 AS kept FROM m"""


def _q_drop(rule):
    def build(spark, sf):
        out = VR.drop_imbalanced(weak_votes(f1(spark, sf), FLAG), FLAG, rule, 0.9)
        return out.select("verifier", *[r6(c, c) for c in ("p_pos", "p_neg", "p_abstain")], "rule", "kept")
    return build


register("drop_imbalanced", sql=_drop_sql("p_pos > 0.09999999999999998::DOUBLE AND p_pos < 0.9", "all"))(_q_drop("all"))
# class balance of F1 is about 0.33, so the adaptive rule resolves to 'all'
register("drop_imbalanced_adaptive", sql=_drop_sql("p_pos > 0.09999999999999998::DOUBLE AND p_pos < 0.9", "all"))(_q_drop("adaptive"))
register("drop_imbalanced_small", sql=_drop_sql("p_pos > 0.5", "small"))(_q_drop("small"))


@register("drop_imbalanced_mean", sql=f"""WITH {_votes_sql(FLAG)}, m AS ({_marg_sql(FLAG)})
SELECT verifier, round(mean, 6) AS mean, mean > 0.1 AND mean < 0.9 AS kept FROM m""")
def drop_imbalanced_mean(spark, sf):
    out = VR.drop_imbalanced_mean(weak_votes(f1(spark, sf), FLAG), FLAG, "all")
    return out.select("verifier", r6("mean", "mean"), "kept")


IND = ["j80", "j70", "j60", "j_abstain", "rm_disc"]


@register("independent_subset")
def independent_subset(spark, sf):
    """3-subset with the sparsest inverse covariance (with y), searched over spark.range(C(V,3))."""
    votes = weak_votes(f1(spark, sf), IND)
    return VR.independent_subset(votes, IND, 3)


@register("dependency_pairs")
def dependency_pairs(spark, sf):
    votes = weak_votes(f1(spark, sf), IND)
    return VR.dependency_pairs(votes, IND, 0.3)
