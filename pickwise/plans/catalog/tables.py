"""Catalog: sources, sinks, table hygiene (ops 1-13, 15-21)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.models.naive_bayes import nb_fit, nb_score
from pickwise.operators.sampling import stratified_split
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.catalog.metrics import _split_sql
from pickwise.plans.registry import register
from pickwise.plans.selection import weak_votes
from pickwise.session import ensure_checkpoint_dir
from pickwise.sources import tables as T
from pickwise.sources.fixtures import F6_SQL_CTE, f1, f1dev, f2, f6

IDS = ["problem_id", "sample_idx"]


def _arr_str(c):
    """Deterministic text of a string/int list for the value hash (NULL entries spelled out)."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), "|")


def _duck_arr_str(c):
    return f"array_to_string(list_transform({c}, lambda x: coalesce(CAST(x AS VARCHAR), 'NULL')), '|')"


# ---------------------------------------------------------------- 1, 3, 4, 7

@register("load_responses", sql="""SELECT problem_id, sample_idx, answer AS extracted_answers, y AS answer_correct,
  round(rm_q, 6) AS rm_q_scores, j80 AS j80_verdicts FROM f1
  WHERE NOT (problem_id % 7 = 0 AND sample_idx = (SELECT max(sample_idx) FROM f1 g WHERE g.problem_id = f1.problem_id))""")
def load_responses(spark, sf):
    """List-form table -> verifier columns found by suffix -> row form (the short rm_q list of
    problem_id % 7 = 0 leaves its last sample out of the zip's full rows)."""
    lf = T.load_responses(spark, f6(spark, sf))
    vs = [c for c in T.verifier_columns(lf) if c in ("rm_q_scores", "j80_verdicts")]
    rows = T.explode_samples(lf, ["extracted_answers", "answer_correct", *vs])
    return rows.join(_short_tail(spark, sf), IDS, "left_anti").select(
        *IDS, "extracted_answers", "answer_correct", r6("rm_q_scores", "rm_q_scores"), "j80_verdicts")


def _short_tail(spark, sf):
    """(problem_id, sample_idx) of the dropped score of the shortened lists."""
    d = f1(spark, sf)
    last = d.groupBy("problem_id").agg(F.max("sample_idx").alias("sample_idx"))
    return last.filter(F.col("problem_id") % 7 == 0)


@register("explode_samples", sql="""SELECT problem_id, sample_idx, round(rm_null, 6) AS rm_null_scores, j70 AS j70_verdicts,
  'The answer is: ' || coalesce(answer, '') AS samples FROM f1""")
def explode_samples(spark, sf):
    lf = f6(spark, sf)
    rows = T.explode_samples(lf, ["samples", "rm_null_scores", "j70_verdicts"])
    return rows.select(*IDS, r6("rm_null_scores", "rm_null_scores"), "j70_verdicts", "samples")


@register("collect_samples", sql=f"""WITH {F6_SQL_CTE}
SELECT problem_id, CAST(len(extracted_answers) AS INT) AS n_samples, {_duck_arr_str('extracted_answers')} AS answers,
       {_duck_arr_str('answer_correct')} AS correct, round(coalesce(list_sum(list_filter(rm_null_scores, lambda x: x IS NOT NULL)), 0.0), 6) AS rm_null_sum,
       round(list_sum(list_transform(j80_verdicts, lambda x: x[1])), 6) AS j80_sum FROM f6""")
def collect_samples(spark, sf):
    lf = f6(spark, sf)
    return lf.select("problem_id", F.size("extracted_answers").alias("n_samples"),
                     _arr_str(F.col("extracted_answers")).alias("answers"),
                     _arr_str(F.col("answer_correct")).alias("correct"),
                     r6(F.aggregate(F.filter("rm_null_scores", lambda x: x.isNotNull()), F.lit(0.0),
                                    lambda a, x: a + x), "rm_null_sum"),
                     r6(F.aggregate(T.squeeze_verdicts("j80_verdicts"), F.lit(0.0), lambda a, x: a + x), "j80_sum"))


@register("squeeze_verdicts", sql=f"""WITH {F6_SQL_CTE}
SELECT problem_id, {_duck_arr_str('list_transform(j70_verdicts, lambda x: CAST(x[1] AS INT))')} AS j70 FROM f6""")
def squeeze_verdicts(spark, sf):
    lf = f6(spark, sf)
    sq = T.squeeze_verdicts("j70_verdicts")
    return lf.select("problem_id", _arr_str(F.transform(sq, lambda x: x.cast("int"))).alias("j70"))


# ---------------------------------------------------------------- 5, 6

MELT = ["rm_q", "j80", "j_abstain", "rm_null"]


def _sql_melt(vs):
    return " UNION ALL ".join(f"SELECT problem_id, sample_idx, '{v}' AS verifier, round({v}, 6) AS score FROM f1" for v in vs)


@register("melt_scores", sql=_sql_melt(MELT))
def melt_scores(spark, sf):
    m = T.melt_scores(f1(spark, sf), MELT)
    return m.select(*IDS, "verifier", r6("score", "score"))


@register("pivot_scores", sql=f"SELECT problem_id, sample_idx, {Q.round_cols(MELT)} FROM f1")
def pivot_scores(spark, sf):
    w = T.pivot_scores(T.melt_scores(f1(spark, sf), MELT), MELT)
    return w.select(*IDS, *[r6(v, v) for v in MELT])


# ---------------------------------------------------------------- 8, 21

def _scratch(spark, name):
    """A folder of this run below the shared checkpoint folder: two runs never share one."""
    return os.path.join(ensure_checkpoint_dir(spark), "pickwise-out", f"{name}-{uuid.uuid4().hex}")


@register("write_dataset", sql="SELECT problem_id, sample_idx, y, round(rm_q, 6) AS rm_q, j80 FROM f1")
def write_dataset(spark, sf):
    """Write the score table (overwrite, committer swap) and read it back."""
    path = _scratch(spark, f"write_dataset/{os.path.basename(sf.rstrip('/'))}")
    back = T.write_dataset(f1(spark, sf).select(*IDS, "y", "rm_q", "j80"), path)
    return back.select(*IDS, "y", r6("rm_q", "rm_q"), "j80")


@register("save_params", sql=f"""WITH prm AS ({Q.nb_params('f1', ['j80', 'j70', 'j60'])}),
s AS ({Q.nb_p1('f1', 'prm', ['j80', 'j70', 'j60'])}) SELECT problem_id, sample_idx, round(p1, 6) AS p1 FROM s""")
def save_params(spark, sf):
    """Fit naive Bayes, persist its parameter table, load it back and score with it."""
    vs = ["j80", "j70", "j60"]
    votes = f1(spark, sf).select(*IDS, "y", *vs)
    path = _scratch(spark, f"params/{os.path.basename(sf.rstrip('/'))}")
    T.save_params(nb_fit(votes, vs), path, "naive_bayes", vs)
    params, loaded = T.load_params(spark, path)
    return nb_score(votes, params, loaded).select(*IDS, r6("p1", "p1"))


# ---------------------------------------------------------------- 9

REGISTRY_ROWS = [("rm_q", "QualityRM", 0), ("rm_disc", "QualityRM", 1), ("j80", "Judge80", 2), ("j70", "Judge70", 3)]


def _registry(spark):
    return spark.createDataFrame(REGISTRY_ROWS, "raw_name string, name string, position int")


@register("rename_verifiers", sql="""
WITH reg AS (SELECT * FROM (VALUES ('rm_q', 'QualityRM', 0), ('rm_disc', 'QualityRM', 1), ('j80', 'Judge80', 2), ('j70', 'Judge70', 3)) t(raw_name, name, position)),
long AS (SELECT problem_id, sample_idx, 'rm_q' AS verifier, 0 AS position, rm_q AS score FROM f1
         UNION ALL SELECT problem_id, sample_idx, 'rm_disc', 1, rm_disc FROM f1
         UNION ALL SELECT problem_id, sample_idx, 'j80', 2, j80 FROM f1
         UNION ALL SELECT problem_id, sample_idx, 'j60', 4, j60 FROM f1)
SELECT problem_id, sample_idx, coalesce(reg.name, long.verifier) AS verifier, round(score, 6) AS score
FROM long LEFT JOIN reg ON long.verifier = reg.raw_name WHERE long.verifier <> 'rm_disc'""")
def rename_verifiers(spark, sf):
    """rm_q and rm_disc both map to QualityRM: the first (rm_q) is kept; j60 is unknown and stays."""
    d = f1(spark, sf)
    vs = ["rm_q", "rm_disc", "j80", "j60"]
    long = d.select(*IDS, F.explode(F.array(*[
        F.struct(F.lit(v).alias("verifier"), F.lit(p).alias("position"), F.col(v).alias("score"))
        for v, p in zip(vs, [0, 1, 2, 4])])).alias("s")).select(*IDS, "s.*")
    out = T.rename_verifiers(long, _registry(spark), on_dup="first")
    return out.select(*IDS, "verifier", r6("score", "score"))


# ---------------------------------------------------------------- 10-13

@register("check_input", sql=f"""WITH {F6_SQL_CTE}
SELECT problem_id, 'no_answer' AS reasons FROM f6 WHERE answer IS NULL""")
def check_input(spark, sf):
    return T.check_input(f6(spark, sf), "math")


@register("row_range", sql="""
WITH pos AS (SELECT problem_id, row_number() OVER (ORDER BY problem_id) - 1 AS position FROM (SELECT DISTINCT problem_id FROM f1))
SELECT f1.problem_id, sample_idx, y FROM f1 JOIN pos ON f1.problem_id = pos.problem_id WHERE position >= 100 AND position < 5100""")
def row_range(spark, sf):
    return T.row_range(f1(spark, sf), 100, 10100, 5000).select(*IDS, "y")


@register("limit_samples", sql="SELECT problem_id, sample_idx, y FROM f1 WHERE sample_idx < 3")
def limit_samples(spark, sf):
    return T.limit_samples(f1(spark, sf), 3).select(*IDS, "y")


@register("limit_samples_lists", sql=f"""WITH {F6_SQL_CTE}
SELECT problem_id, {_duck_arr_str('list_slice(extracted_answers, 1, 2)')} AS answers,
       {_duck_arr_str('list_slice(answer_correct, 1, 2)')} AS correct FROM f6""")
def limit_samples_lists(spark, sf):
    lf = f6(spark, sf)
    cut = T.limit_samples(lf, 2, T.sample_aligned_columns(lf))
    return cut.select("problem_id", _arr_str(F.col("extracted_answers")).alias("answers"),
                      _arr_str(F.col("answer_correct")).alias("correct"))


@register("check_lengths", sql=f"""WITH {F6_SQL_CTE}
SELECT problem_id, 'rm_q_scores' AS verifier, CAST(len(samples) AS INT) AS n_samples, CAST(len(rm_q_scores) AS INT) AS n_scores
FROM f6 WHERE len(samples) <> len(rm_q_scores)""")
def check_lengths(spark, sf):
    return T.check_lengths(f6(spark, sf), ["rm_q_scores", "rm_null_scores"])


@register("filter_type", sql="SELECT problem_id, sample_idx, y FROM f1 WHERE gt_answer = 'A'")
def filter_type(spark, sf):
    return T.filter_type(f1(spark, sf), "gt_answer", "A").select(*IDS, "y")


# ---------------------------------------------------------------- 16, 17

R_FLAT = 32


def _dev_lines(spark, sf):
    """Dev-set lines derived from F1dev: 'problem sample' pairs, flat indices for problem_id % 40 = 20,
    plus one line per problem pointing past its last sample (dropped on parsing)."""
    dv = f1dev(spark, sf)
    pair = F.concat_ws(" ", F.col("problem_id").cast("string"), F.col("sample_idx").cast("string"))
    flat = (F.col("problem_id") * R_FLAT + F.col("sample_idx")).cast("string")
    lines = dv.select(F.when(F.col("problem_id") % 40 == 20, flat).otherwise(pair).alias("value"),
                      (F.col("problem_id") * 100 + F.col("sample_idx")).alias("line_no"))
    beyond = dv.groupBy("problem_id").agg(F.max("sample_idx").alias("m")).select(
        F.concat_ws(" ", F.col("problem_id").cast("string"), (F.col("m") + 20).cast("string")).alias("value"),
        (F.col("problem_id") * 100 + 99).alias("line_no"))
    return lines.unionByName(beyond)


@register("dev_set", fixtures=("f1", "f1dev"), sql="SELECT problem_id, sample_idx, CAST(dev_label AS INT) AS dev_label FROM f1dev")
def dev_set(spark, sf):
    return T.dev_set(_dev_lines(spark, sf), f1(spark, sf), R_FLAT)


@register("dev_set_external_labels", fixtures=("f1", "f1dev"),
          sql="SELECT problem_id, sample_idx, CAST(CASE WHEN sample_idx = 0 THEN 1 - dev_label ELSE dev_label END AS INT) AS dev_label FROM f1dev")
def dev_set_external_labels(spark, sf):
    """External labels (flipped on sample 0) override the rows' own labels."""
    lines = _dev_lines(spark, sf)
    dv = f1dev(spark, sf)
    labels = dv.filter(F.col("sample_idx") == 0).select(
        (F.col("problem_id") * 100 + F.col("sample_idx")).alias("line_no"),
        (F.lit(1) - F.col("dev_label")).alias("dev_label"))
    return T.dev_set(lines, f1(spark, sf), R_FLAT, labels)


@register("subset_fraction", sql="""SELECT problem_id, sample_idx, y FROM (
  SELECT *, row_number() OVER (ORDER BY problem_id, sample_idx) AS rk, count(*) OVER () AS n FROM f1)
WHERE rk <= CAST(floor(n * 0.3::DOUBLE) AS BIGINT)""")
def subset_fraction(spark, sf):
    return T.subset_fraction(f1(spark, sf), 0.3).select(*IDS, "y")


# ---------------------------------------------------------------- 2, 18-20

@register("union_sources", fixtures=("f1", "f2"), sql="""
SELECT 0 AS source, problem_id, CAST(dense_rank() OVER (ORDER BY problem_id) - 1 AS BIGINT) AS problem_idx, sample_idx, y FROM f1
UNION ALL
SELECT 1, problem_id, CAST(dense_rank() OVER (ORDER BY problem_id) - 1 + (SELECT count(DISTINCT problem_id) FROM f1) AS BIGINT), sample_idx, y FROM f2""")
def union_sources(spark, sf):
    a = f1(spark, sf).select(*IDS, "y")
    b = f2(spark, sf).select(*IDS, "y")
    return T.union_sources([a, b]).select("source", "problem_id", "problem_idx", "sample_idx", "y")


FLAG = ["rm_q", "rm_price", "rm_disc", "rm_null", "j80", "j70", "j60", "j_always"]


def _nb_p1_sql():
    fill = ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in FLAG)
    return (f"n AS ({Q.minmax_all('f1', FLAG)}), nf AS (SELECT problem_id, sample_idx, y, {fill} FROM n), "
            f"b AS ({Q.binarize('nf', FLAG)}), prm AS ({Q.nb_params('b', FLAG)}), s AS ({Q.nb_p1('b', 'prm', FLAG)})")


def _nb_scored(spark, sf):
    votes = weak_votes(f1(spark, sf), FLAG)
    return nb_score(votes, nb_fit(votes, FLAG), FLAG)


@register("export_scores", sql=f"""WITH {_nb_p1_sql()}
SELECT problem_id, sample_idx, round(p1, 6) AS prob, CASE WHEN p1 > 0.5 THEN 'positive' ELSE 'negative' END AS bucket FROM s""")
def export_scores(spark, sf):
    e = T.export_scores(_nb_scored(spark, sf))
    return e.select(*IDS, r6("prob", "prob"), "bucket")


@register("export_null_scores", fixtures=("f1", "f2"), sql="""
SELECT CAST(dense_rank() OVER (ORDER BY problem_id) - 1 AS BIGINT) AS task_id, sample_idx, CAST(NULL AS DOUBLE) AS prob, 'null' AS bucket FROM f1
UNION ALL
SELECT CAST(dense_rank() OVER (ORDER BY problem_id) - 1 + (SELECT count(DISTINCT problem_id) FROM f1) AS BIGINT), sample_idx, NULL, 'null' FROM f2""")
def export_null_scores(spark, sf):
    return T.export_null_scores([f1(spark, sf), f2(spark, sf)])


@register("attach_scores", sql=f"""WITH {_nb_p1_sql()}, {F6_SQL_CTE}, {_split_sql()},
sc AS (SELECT s.problem_id, list(p1 ORDER BY sample_idx) AS scores FROM s JOIN split ON s.problem_id = split.problem_id
       WHERE split.set = 'test' GROUP BY s.problem_id)
SELECT f6.problem_id, CAST(len(coalesce(sc.scores, list_transform(f6.samples, lambda x: 0.0))) AS INT) AS n_scores,
       round(list_sum(coalesce(sc.scores, list_transform(f6.samples, lambda x: 0.0))), 6) AS score_sum
FROM f6 LEFT JOIN sc ON f6.problem_id = sc.problem_id""")
def attach_scores(spark, sf):
    """Scores exist for the evaluated (test-split) problems; train problems get zeros."""
    scored = _nb_scored(spark, sf)
    test = stratified_split(f1(spark, sf), 0.8, 42, 10).filter(F.col("set") == "test").select("problem_id")
    s = scored.join(test, "problem_id", "left_semi")
    lists = T.collect_samples(s.withColumnRenamed("p1", "scores"), ["scores"])
    out = T.attach_scores(f6(spark, sf), lists)
    return out.select("problem_id", F.size("selection_scores").alias("n_scores"),
                      r6(F.aggregate("selection_scores", F.lit(0.0), lambda a, x: a + x), "score_sum"))
