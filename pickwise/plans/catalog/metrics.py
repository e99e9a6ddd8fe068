"""Catalog: selection and evaluation metrics (ops 80, 91-118, 157, 158)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions.columns import r6, sum_cols
from pickwise.operators import metrics as M
from pickwise.operators.sampling import difficulty_bins, stratified_split
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.registry import register
from pickwise.plans.selection import naive_bayes_selection
from pickwise.sources.fixtures import F1_CLEAN_JUDGES, F1_VERIFIERS, f1, f5

ENS = F1_CLEAN_JUDGES
ENS_SQL = "(j80 + j70 + j60) / 3.0"
FLAG = ["rm_q", "rm_price", "rm_disc", "rm_null", "j80", "j70", "j60", "j_always"]


def ens(df):
    return df.withColumn("p1", sum_cols(ENS) / F.lit(float(len(ENS))))


def _round_all(df, skip=()):
    return df.select(*[r6(c, c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


ENS_CTE = f"s AS (SELECT problem_id, sample_idx, y, {ENS_SQL} AS p1 FROM f1)"


# ---------------------------------------------------------------- 91-94

@register("select_top1", sql=f"WITH {ENS_CTE} {Q.top1('s')}")
def select_top1(spark, sf):
    return M.select_top1(ens(f1(spark, sf)))


@register("sample_metrics", sql=f"WITH {ENS_CTE}, m AS ({Q.sample_metrics('s')}) "
          "SELECT problem_id, round(sample_accuracy, 6) AS sample_accuracy, sample_tp, sample_tn, sample_fp, sample_fn, num_samples FROM m")
def sample_metrics(spark, sf):
    return _round_all(M.sample_metrics(ens(f1(spark, sf))))


@register("prediction_metrics", sql=f"WITH {ENS_CTE} {Q.prediction_metrics('s')}")
def prediction_metrics(spark, sf):
    return M.prediction_metrics(ens(f1(spark, sf)))


def _sql_flagship_results(vs):
    fill = ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in vs)
    return (f"n AS ({Q.minmax_all('f1', vs)}), nf AS (SELECT problem_id, sample_idx, y, {fill} FROM n), "
            f"b AS ({Q.binarize('nf', vs)}), prm AS ({Q.nb_params('b', vs)}), s AS ({Q.nb_p1('b', 'prm', vs)}), "
            f"t AS ({Q.top1('s')}), sm AS ({Q.sample_metrics('s')}), "
            f"res AS (SELECT 'train' AS set, t.*, sm.sample_accuracy, sm.sample_tp, sm.sample_tn, sm.sample_fp, sm.sample_fn "
            f"FROM t JOIN sm ON t.problem_id = sm.problem_id)")


SUMMARY_SQL = (f"WITH {_sql_flagship_results(FLAG)}, su AS ({Q.summary('res')}) "
               "SELECT set, n_problems, round(select_acc, 6) AS select_acc, round(sample_acc, 6) AS sample_acc, "
               "round(top1_acc, 6) AS top1_acc, select_tp, select_tn, select_fp, select_fn, "
               "sample_tp, sample_tn, sample_fp, sample_fn FROM su")


def flagship(spark, sf):
    """Naive Bayes selection over all F1 verifiers that vote 0/1 after binarising."""
    res = naive_bayes_selection(f1(spark, sf), FLAG)
    return _round_all(M.summary(res))


register("summary", sql=SUMMARY_SQL)(flagship)


def _split_sql(train=0.8, seed=42, bins=10, src="f1"):
    from pickwise.operators.sampling import bin_edges
    edges = bin_edges(bins)
    cnt = " + ".join(f"CAST(mean_y >= {e!r} AS INT)" for e in edges)
    h = f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', CAST(problem_id AS VARCHAR))), 1, 13)) AS UBIGINT) / 4503599627370496.0"
    return (f"bins AS (SELECT problem_id, mean_y, CAST(least(greatest({cnt} - 1, 0), {len(edges) - 2}) AS INT) AS difficulty "
            f"FROM (SELECT problem_id, avg(y) AS mean_y FROM {src} GROUP BY problem_id)), "
            f"split AS (SELECT problem_id, difficulty, CASE WHEN rk <= floor({train}::DOUBLE * n) THEN 'train' ELSE 'test' END AS set "
            f"FROM (SELECT problem_id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY {h}) AS rk, "
            f"count(*) OVER (PARTITION BY difficulty) AS n FROM bins))")


@register("summary_by_difficulty", sql=f"""WITH {ENS_CTE}, {_split_sql()}, t AS ({Q.top1('s')}), sm AS ({Q.sample_metrics('s')}),
res AS (SELECT split.set, split.difficulty, t.*, sm.sample_accuracy FROM t JOIN sm ON t.problem_id = sm.problem_id
        JOIN split ON t.problem_id = split.problem_id),
side AS (SELECT set, difficulty, count(*) AS n, avg(top1_positive) AS sel, avg(sample_accuracy) AS samp,
         CAST(sum(top1_tp) + sum(top1_tn) AS DOUBLE) / count(*) AS top1 FROM res GROUP BY set, difficulty),
tr AS (SELECT * FROM side WHERE set = 'train'), te AS (SELECT * FROM side WHERE set = 'test')
SELECT coalesce(tr.difficulty, te.difficulty) AS difficulty,
       tr.n AS train_problems, round(tr.sel, 6) AS train_select_acc, round(tr.samp, 6) AS train_sample_acc, round(tr.top1, 6) AS train_top1_acc,
       te.n AS test_problems, round(te.sel, 6) AS test_select_acc, round(te.samp, 6) AS test_sample_acc, round(te.top1, 6) AS test_top1_acc
FROM tr FULL OUTER JOIN te ON tr.difficulty = te.difficulty""")
def summary_by_difficulty(spark, sf):
    d = ens(f1(spark, sf))
    split = stratified_split(d, 0.8, 42, 10)
    res = M.problem_results(d, "p1").join(split, "problem_id")
    return _round_all(M.summary_by_difficulty(res))


@register("assemble_results", sql=f"""WITH {ENS_CTE}, {_split_sql()}, t AS ({Q.top1('s')}), sm AS ({Q.sample_metrics('s')}),
pm AS ({Q.prediction_metrics('s')})
SELECT split.set, t.problem_id, t.top1_idx, t.top1_positive, round(sm.sample_accuracy, 6) AS sample_accuracy,
       pm.prediction_idx, pm.prediction_accuracy, split.difficulty, round(cb.class_balance, 6) AS class_balance
FROM t JOIN sm ON t.problem_id = sm.problem_id JOIN pm ON t.problem_id = pm.problem_id
JOIN split ON t.problem_id = split.problem_id
JOIN (SELECT problem_id, avg(y) AS class_balance FROM f1 GROUP BY problem_id) cb ON t.problem_id = cb.problem_id""")
def assemble_results(spark, sf):
    d = ens(f1(spark, sf))
    split = stratified_split(d, 0.8, 42, 10)
    res = M.assemble_results(d, split, "p1")
    return _round_all(res)


# ---------------------------------------------------------------- pass@k

@register("pass_at_k", sql="""
WITH g AS (SELECT problem_id, count(*) AS n, max(CASE WHEN sample_idx < 1 THEN y END) AS h1,
                  max(CASE WHEN sample_idx < 2 THEN y END) AS h2, max(CASE WHEN sample_idx < 4 THEN y END) AS h4
           FROM f1 GROUP BY problem_id),
r AS (SELECT 1 AS k, h1 AS hit, n FROM g UNION ALL SELECT 2, h2, n FROM g UNION ALL SELECT 4, h4, n FROM g)
SELECT k, round(avg(hit), 6) AS pass_at_k FROM r WHERE n >= k GROUP BY k""")
def pass_at_k(spark, sf):
    return _round_all(M.pass_at_k(f1(spark, sf), [1, 2, 4]))


@register("pass_at_k_ragged", sql="""
WITH g AS (SELECT problem_id, count(*) AS n, max(CASE WHEN sample_idx < 1 THEN y END) AS h1,
                  max(CASE WHEN sample_idx < 4 THEN y END) AS h4, max(CASE WHEN sample_idx < 8 THEN y END) AS h8
           FROM f1 GROUP BY problem_id),
r AS (SELECT 1 AS k, h1 AS hit, n FROM g UNION ALL SELECT 4, h4, n FROM g UNION ALL SELECT 8, h8, n FROM g)
SELECT k, round(avg(hit), 6) AS pass_at_k FROM r WHERE n >= k GROUP BY k""")
def pass_at_k_ragged(spark, sf):
    return _round_all(M.pass_at_k(f1(spark, sf), [1, 4, 8]))


def _sql_unbiased(src, ks, m=None):
    where = f"WHERE sample_idx < {m}" if m is not None else ""
    return f"""WITH g AS (SELECT problem_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS c FROM {src} {where} GROUP BY problem_id),
r AS (SELECT n, c, k FROM g, (SELECT unnest({list(ks)}) AS k) WHERE k <= n)
SELECT k, round(avg(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
       ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - CAST(k AS DOUBLE) / i)) END), 6) AS pass_at_k
FROM r GROUP BY k"""


@register("pass_at_k_unbiased", sql=_sql_unbiased("f1", [1, 2, 4, 8]))
def pass_at_k_unbiased(spark, sf):
    return _round_all(M.pass_at_k_unbiased(f1(spark, sf), [1, 2, 4, 8]))


@register("pass_at_k_unbiased_first_m", sql=_sql_unbiased("f1", [1, 2, 3], 3))
def pass_at_k_unbiased_first_m(spark, sf):
    return _round_all(M.pass_at_k_unbiased(f1(spark, sf), [1, 2, 3], 3))


# ---------------------------------------------------------------- majority

MV_A = """a AS (SELECT problem_id, answer, count(*) AS cnt, sum(y) AS nc, min(sample_idx) AS first_idx,
          arg_min(y, sample_idx) AS first_y FROM {src} WHERE answer IS DISTINCT FROM 'NO_ANSWER' {extra} GROUP BY problem_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY cnt DESC, first_idx) AS rk FROM a)"""


@register("majority_vote", sql="WITH " + MV_A.format(src="f1", extra="") + """
SELECT problem_id, CAST(nc > cnt / 2.0 AS INT) AS majority_correct, CAST(first_idx AS INT) AS majority_idx FROM r WHERE rk = 1""")
def majority_vote(spark, sf):
    return M.majority_vote(f1(spark, sf), 1, "majority")


@register("majority_vote_top3_one_sample", sql="WITH " + MV_A.format(src="f1", extra="") + """
SELECT problem_id, CAST(max(CASE WHEN first_y = 1 THEN 1 ELSE 0 END) AS INT) AS majority_correct,
       CAST(arg_min(first_idx, CASE WHEN first_y = 1 THEN rk ELSE rk + 3 END) AS INT) AS majority_idx
FROM r WHERE rk <= 3 GROUP BY problem_id""")
def majority_vote_top3_one_sample(spark, sf):
    return M.majority_vote(f1(spark, sf), 3, "one_sample")


def _sql_majority_at_k(ks):
    parts = []
    for k in ks:
        parts.append(f"SELECT {k} AS k, avg(CAST(nc > cnt / 2.0 AS INT)) AS acc FROM (" +
                     "WITH " + MV_A.format(src="f1", extra=f"AND sample_idx < {k} AND problem_id IN (SELECT problem_id FROM f1 GROUP BY problem_id HAVING count(*) >= {k})") + " SELECT * FROM r WHERE rk = 1)")
    return f"SELECT k, round(acc, 6) AS majority_at_k FROM ({' UNION ALL '.join(parts)})"


@register("majority_at_k", sql=_sql_majority_at_k([1, 2, 3, 4]))
def majority_at_k(spark, sf):
    return _round_all(M.majority_at_k(f1(spark, sf), [1, 2, 3, 4]))


MV_ALL = """a AS (SELECT problem_id, answer, count(*) AS cnt, sum(y) AS nc, min(sample_idx) AS first_idx FROM {src} GROUP BY problem_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY cnt DESC, first_idx) AS rk FROM a)"""


@register("majority_top1", sql="WITH " + MV_ALL.format(src="f1") + """
SELECT CAST(sum(CASE WHEN nc > cnt / 2.0 THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total,
       round(avg(CASE WHEN nc > cnt / 2.0 THEN 1 ELSE 0 END), 6) AS accuracy FROM r WHERE rk = 1""")
def majority_top1(spark, sf):
    return _round_all(M.majority_top1(f1(spark, sf)))


SOLV = "(SELECT * FROM f1 WHERE problem_id IN (SELECT problem_id FROM f1 GROUP BY problem_id HAVING max(y) = 1))"


@register("majority_top1_solvable", sql="WITH sv AS " + SOLV + ", " + MV_ALL.format(src="sv") + """
SELECT CAST(sum(CASE WHEN nc > cnt / 2.0 THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total,
       round(avg(CASE WHEN nc > cnt / 2.0 THEN 1 ELSE 0 END), 6) AS accuracy FROM r WHERE rk = 1""")
def majority_top1_solvable(spark, sf):
    return _round_all(M.majority_top1(f1(spark, sf), only_solvable=True))


# ---------------------------------------------------------------- accuracies

def _sql_sel1(src, score):
    return (f"SELECT round(avg(y), 6) AS accuracy, count(*) AS total FROM (SELECT y, row_number() OVER "
            f"(PARTITION BY problem_id ORDER BY {score} DESC, sample_idx) AS rk FROM {src}) WHERE rk = 1")


@register("selection_at_1", sql=_sql_sel1("f1", "rm_q"))
def selection_at_1(spark, sf):
    return _round_all(M.selection_at_1(f1(spark, sf), "rm_q"))


@register("selection_at_1_solvable", sql=f"WITH sv AS {SOLV} {_sql_sel1('sv', 'rm_price')}")
def selection_at_1_solvable(spark, sf):
    return _round_all(M.selection_at_1(f1(spark, sf), "rm_price", only_solvable=True))


@register("first_sample_accuracy", sql="SELECT round(avg(y), 6) AS accuracy, count(*) AS total FROM f1 WHERE sample_idx = 0")
def first_sample_accuracy(spark, sf):
    return _round_all(M.first_sample_accuracy(f1(spark, sf)))


@register("answerable_counts", sql="""SELECT count_if(m = 1) AS answerable, count(*) AS total
FROM (SELECT problem_id, max(y) AS m FROM f1 GROUP BY problem_id)""")
def answerable_counts(spark, sf):
    return M.answerable_counts(f1(spark, sf))


@register("evaluation_report", sql=f"""
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'selection_at_1' AS metric, accuracy AS value FROM ({_sql_sel1('f1', 'rm_q')})
  UNION ALL SELECT 'first_sample', avg(y) FROM f1 WHERE sample_idx = 0
  UNION ALL SELECT 'majority_at_1', avg(CASE WHEN nc > cnt / 2.0 THEN 1 ELSE 0 END) FROM (WITH {MV_ALL.format(src='f1')} SELECT * FROM r WHERE rk = 1)
  UNION ALL SELECT 'ensemble_selection_at_1', accuracy FROM ({_sql_sel1(f"(SELECT *, {ENS_SQL} AS ens FROM f1)", 'ens')})
  UNION ALL SELECT 'answerable', CAST(count_if(m = 1) AS DOUBLE) FROM (SELECT max(y) AS m FROM f1 GROUP BY problem_id)
  UNION ALL SELECT 'total_problems', CAST(count(DISTINCT problem_id) AS DOUBLE) FROM f1)""")
def evaluation_report(spark, sf):
    return _round_all(M.evaluation_report(f1(spark, sf), "rm_q", ENS))


def _sql_vtop1(vs):
    parts = []
    for i, v in enumerate(vs):
        parts.append(f"SELECT '{v}' AS verifier, {i} AS pos, problem_id, y FROM (SELECT problem_id, y, row_number() OVER "
                     f"(PARTITION BY problem_id ORDER BY {v} DESC NULLS LAST, sample_idx) AS rk FROM f1) WHERE rk = 1")
    return " UNION ALL ".join(parts)


@register("best_verifier", sql=f"""
WITH t AS ({_sql_vtop1(F1_VERIFIERS)}), acc AS (SELECT verifier, pos, avg(y) AS a FROM t GROUP BY verifier, pos)
SELECT round(max(a), 6) AS best_verifier_accuracy, (SELECT verifier FROM acc ORDER BY a DESC, pos LIMIT 1) AS best_verifier FROM acc""")
def best_verifier(spark, sf):
    return _round_all(M.best_verifier(f1(spark, sf), F1_VERIFIERS))


def _sql_sel_at_k(score_expr, ks):
    parts = []
    for k in ks:
        parts.append(f"""SELECT {k} AS k, avg(y) AS accuracy FROM (
  SELECT y, row_number() OVER (PARTITION BY problem_id ORDER BY sc DESC, sample_idx) AS rk FROM (
    SELECT *, {score_expr} AS sc, count(*) OVER (PARTITION BY problem_id) AS n FROM f1) WHERE sample_idx < {k} AND n >= {k})
  WHERE rk = 1""")
    return f"SELECT k, round(accuracy, 6) AS accuracy FROM ({' UNION ALL '.join(parts)})"


@register("selection_at_k", sql=_sql_sel_at_k("rm_q", [1, 2, 4, 8]))
def selection_at_k(spark, sf):
    return _round_all(M.selection_at_k(f1(spark, sf), "rm_q", [1, 2, 4, 8]))


@register("ensemble_at_k", sql=_sql_sel_at_k(ENS_SQL, [1, 2, 4, 8]))
def ensemble_at_k(spark, sf):
    return _round_all(M.ensemble_at_k(f1(spark, sf), ENS, [1, 2, 4, 8]))


def _sql_f1(vs):
    parts = [f"SELECT '{v}' AS verifier, count_if({v} >= 0.5 AND y = 1) AS tp, count_if({v} >= 0.5 AND y = 0) AS fp, "
             f"count_if(NOT ({v} >= 0.5) AND y = 1) AS fn FROM f1" for v in vs]
    return f"""SELECT verifier, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-8), 6) AS f1 FROM (
  SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM ({' UNION ALL '.join(parts)}))"""


@register("verifier_f1", sql=_sql_f1(F1_VERIFIERS))
def verifier_f1(spark, sf):
    return _round_all(M.verifier_f1(f1(spark, sf), F1_VERIFIERS))


@register("verifier_top1_score", sql=f"""
WITH t AS ({_sql_vtop1(F1_VERIFIERS)}), hm AS (SELECT verifier, CAST(sum(y) AS DOUBLE) AS h, CAST(sum(1 - y) AS DOUBLE) AS m FROM t GROUP BY verifier)
SELECT verifier, CAST(h AS BIGINT) AS hits, CAST(m AS BIGINT) AS misses,
       round(0.5 * (h / (h + h + 1e-8)) * (m / (m + h + 1e-8)), 6) AS score_as_written, round(h / (h + m + 1e-8), 6) AS hit_rate FROM hm""")
def verifier_top1_score(spark, sf):
    return _round_all(M.verifier_top1_score(f1(spark, sf), F1_VERIFIERS))


@register("random_baseline", sql="""SELECT round(avg(a), 6) AS random_accuracy, count(*) AS n_problems
FROM (SELECT problem_id, avg(y) AS a FROM f1 GROUP BY problem_id)""")
def random_baseline(spark, sf):
    return _round_all(M.random_baseline(f1(spark, sf)))


@register("generation_gap", sql="""SELECT round(avg(hp), 6) AS coverage, round(avg(y), 6) AS selection_accuracy,
       round(avg(hp) - avg(y), 6) AS generation_gap FROM (
  SELECT y, max(y) OVER (PARTITION BY problem_id) AS hp, row_number() OVER (PARTITION BY problem_id ORDER BY rm_q DESC, sample_idx) AS rk FROM f1)
WHERE rk = 1""")
def generation_gap(spark, sf):
    return _round_all(M.generation_gap(f1(spark, sf), "rm_q"))


@register("sweep_summary", fixtures=("f5",), sql="""
SELECT model_type, model_size, train_split, model_class, count(*) AS n_runs,
       round(avg(test_select_accuracy), 6) AS mean_accuracy, round(stddev_samp(test_select_accuracy), 6) AS sd_accuracy
FROM f5 GROUP BY model_type, model_size, train_split, model_class""")
def sweep_summary(spark, sf):
    return _round_all(M.sweep_summary(f5(spark, sf), ["model_type", "model_size", "train_split", "model_class"]),
                      skip=("train_split",))
