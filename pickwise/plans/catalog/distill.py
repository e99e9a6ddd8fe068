"""Catalog: distillation data and scorer, scoring contract, calibration (ops 31-32, 150-156)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pickwise.functions import text as TX
from pickwise.functions.columns import r6
from pickwise.functions.joins import written
from pickwise.operators import distill as DS
from pickwise.operators import scores as S
from pickwise.operators import scoring as SC
from pickwise.plans.catalog.text import _duck_verdict
from pickwise.plans.registry import register
from pickwise.sources.fixtures import f1, f3, f6, read_table
from pickwise.sources.tables import collect_samples

IDS = ["problem_id", "sample_idx"]
PL = ["j80", "j70", "j60", "rm_null"]


@register("pseudo_labels", sql="SELECT problem_id, sample_idx, round((j80 + j70 + j60 + rm_null) / 4.0, 6) AS label FROM f1")
def pseudo_labels(spark, sf):
    return DS.pseudo_labels(f1(spark, sf), PL).select(*IDS, r6("label", "label"))


def _f3_lists(spark, sf):
    """Conversations in list form: one row per conversation (instruction of its first reply),
    replies and their parsed judge verdicts."""
    d = f3(spark, sf)
    rows = d.select("problem_id", "sample_idx", F.col("response").alias("samples"),
                    TX.parse_verdict("judge_reply").alias("judge_scores"))
    lists = collect_samples(rows, ["samples", "judge_scores"])
    first = d.filter(F.col("sample_idx") == 0).select("problem_id", "instruction")
    return lists.join(first, "problem_id")


def _pairs(spark, sf):
    a = f6(spark, sf).select("problem_id", "instruction", "samples", "rm_null_scores", "j80_verdicts")
    return DS.pair_table([(a, ["rm_null_scores", "j80_verdicts"]), (_f3_lists(spark, sf), ["judge_scores"])])


def _kept_pairs(spark, sf):
    """The pairs, numbered once and dealt evenly: fits, statistics and predictions all read them."""
    return written(_pairs(spark, sf).repartition("source", "problem_idx"), "pair-table")


@register("pair_table", fixtures=("f1", "f3"), sql=f"""
SELECT 0 AS source, CAST(dense_rank() OVER (ORDER BY problem_id) - 1 AS BIGINT) AS problem_idx, sample_idx,
       'problem ' || CAST(problem_id AS VARCHAR) AS instruction, 'The answer is: ' || coalesce(answer, '') AS response,
       round((rm_null + j80) / 2.0, 6) AS label FROM f1
UNION ALL
SELECT 1, CAST(dense_rank() OVER (ORDER BY problem_id) - 1 + (SELECT count(DISTINCT problem_id) FROM f1) AS BIGINT), sample_idx,
       first_value(instruction) OVER (PARTITION BY problem_id ORDER BY sample_idx), response,
       round({_duck_verdict('judge_reply')}, 6) FROM f3""")
def pair_table(spark, sf):
    """Two list-form sources (order scores, conversation verdicts) -> one pair table."""
    p = _pairs(spark, sf)
    return p.select("source", "problem_idx", F.col("sample_idx").cast("int").alias("sample_idx"),
                    "instruction", "response", r6("label", "label"))


@register("distilled_scorer")
def distilled_scorer(spark, sf):
    """Hashed-feature regression on the pair table's pseudo-labels; predictions per pair."""
    p = _kept_pairs(spark, sf)
    model = DS.distilled_scorer_fit(p)
    return DS.distilled_scorer_score(model, p).select("source", "problem_idx", "sample_idx", "label",
                                                      r6("prediction", "prediction"))


@register("distilled_scorer_report")
def distilled_scorer_report(spark, sf):
    """Fitted on nine tenths of the problems, judged on the others."""
    train, held = DS.split_pairs(_kept_pairs(spark, sf), 0.1)
    return DS.distilled_scorer_report(DS.distilled_scorer_score(DS.distilled_scorer_fit(train), held))


def _history(spark, sf):
    e = read_table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).cast("bigint").alias("epoch"),
                    (F.col("value") / 100.0).alias("loss"))


@register("best_epoch", fixtures=(), sql="""
WITH h AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS epoch,
                  value / 100.0 AS loss FROM events),
i AS (SELECT *, CASE WHEN loss < coalesce(min(loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                                        'inf'::DOUBLE) THEN 1 ELSE 0 END AS imp FROM h),
s AS (SELECT *, epoch - max(CASE WHEN imp = 1 THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS streak FROM i),
st AS (SELECT run_id, min(CASE WHEN streak >= 3 THEN epoch END) AS stop_epoch, count(*) AS n FROM s GROUP BY run_id),
b AS (SELECT s.run_id, max(CASE WHEN imp = 1 AND (st.stop_epoch IS NULL OR s.epoch <= st.stop_epoch) THEN s.epoch END) AS best_epoch
      FROM s JOIN st ON s.run_id = st.run_id GROUP BY s.run_id)
SELECT b.run_id, b.best_epoch, round(h.loss, 6) AS best_loss, st.stop_epoch,
       CAST(CASE WHEN st.stop_epoch IS NULL THEN st.n ELSE st.stop_epoch + 1 END AS BIGINT) AS epochs_seen
FROM b JOIN st ON b.run_id = st.run_id JOIN h ON h.run_id = b.run_id AND h.epoch = b.best_epoch""")
def best_epoch(spark, sf):
    """Loss histories of many runs (events per user in time order); patience 3, min delta 0."""
    b = DS.best_epoch(_history(spark, sf), 3, 0.0)
    return b.select("run_id", "best_epoch", r6("best_loss", "best_loss"), "stop_epoch", "epochs_seen")


@register("best_epoch_delta", fixtures=(), sql="""
WITH RECURSIVE h AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS epoch,
                            value / 100.0 AS loss FROM events),
w(run_id, epoch, best, best_e, streak, seen) AS (
  SELECT run_id, epoch, loss, epoch, 0, 1 FROM h WHERE epoch = 0
  UNION ALL
  SELECT w.run_id, h.epoch,
         CASE WHEN h.loss < w.best - 0.05::DOUBLE THEN h.loss ELSE w.best END,
         CASE WHEN h.loss < w.best - 0.05::DOUBLE THEN h.epoch ELSE w.best_e END,
         CASE WHEN h.loss < w.best - 0.05::DOUBLE THEN 0 ELSE w.streak + 1 END, w.seen + 1
  FROM w JOIN h ON h.run_id = w.run_id AND h.epoch = w.epoch + 1 WHERE w.streak < 3)
SELECT run_id, best_e AS best_epoch, round(best, 6) AS best_loss, CASE WHEN streak >= 3 THEN epoch END AS stop_epoch,
       CAST(seen AS BIGINT) AS epochs_seen
FROM w QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) = 1""")
def best_epoch_delta(spark, sf):
    """Same with min delta 0.05: the running best only moves on a large enough drop."""
    b = DS.best_epoch(_history(spark, sf), 3, 0.05)
    return b.select("run_id", "best_epoch", r6("best_loss", "best_loss"), "stop_epoch", "epochs_seen")


# ---------------------------------------------------------------- 150-152 scoring contract

@register("score_batch", fixtures=("f3",), sql="""SELECT problem_id, sample_idx,
  round(CAST(length(response) AS DOUBLE) / (1 + length(instruction)), 6) AS len_ratio FROM f3""")
def score_batch(spark, sf):
    d = f3(spark, sf).select(*IDS, "instruction", "response")
    out = SC.score_batch(d, SC.length_ratio_scorer, "len_ratio", batch=16)
    return out.select(*IDS, r6("len_ratio", "len_ratio"))


def _failing(instructions, responses):
    if any("?" in r for r in responses):
        raise RuntimeError("scorer failure")
    return SC.length_ratio_scorer(instructions, responses)


_RATIO = "CAST(length(response) AS DOUBLE) / (1 + length(instruction))"


@register("score_many", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, round({_RATIO}, 6) AS len_ratio,
  round(CASE WHEN contains(response, '?') THEN 0.0 ELSE {_RATIO} END, 6) AS fragile,
  round(CASE WHEN contains(response, '?') THEN NULL ELSE {_RATIO} END, 6) AS fragile_prm FROM f3""")
def score_many(spark, sf):
    """Two scorers, one failing on responses with a question mark (NULL -> 0.0 for a scalar
    scorer, NULL kept for a process scorer); a batch that fails is scored row by row."""
    d = f3(spark, sf).select(*IDS, "instruction", "response")
    out = SC.score_many(d, {"len_ratio": SC.length_ratio_scorer, "fragile": _failing, "fragile_prm": _failing},
                        batch=8, kinds={"fragile_prm": "process"})
    return out.select(*IDS, *[r6(c, c) for c in ("len_ratio", "fragile", "fragile_prm")])


@register("inference_cost", fixtures=(), sql="""SELECT stage, calls FROM (
  SELECT 'generation' AS stage, count(*) * 32 AS calls FROM benchmark
  UNION ALL SELECT 'reward_models', count(*) * 32 * 5 FROM benchmark
  UNION ALL SELECT 'judges', count(*) * 32 * 3 * 2 FROM benchmark
  UNION ALL SELECT 'total', count(*) * 32 * (1 + 5 + 3 * 2) FROM benchmark)""")
def inference_cost(spark, sf):
    return SC.inference_cost(read_table(spark, sf, "benchmark"), 32, 5, 3, 2)


# ---------------------------------------------------------------- 31-32 calibration

CAL = ["rm_q", "rm_disc", "rm_null"]


def _sql_isotonic(v):
    """Largest over starts of the least over ends of the mean targets between them, over a problem's distinct scores."""
    return f"""{v}_t AS (SELECT problem_id, {v} AS x, CASE WHEN count(*) OVER p > 1 THEN (row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx) - 1) / (count(*) OVER p - 1)::DOUBLE ELSE 0.0 END AS y
  FROM f1 WHERE {v} IS NOT NULL WINDOW p AS (PARTITION BY problem_id)),
{v}_u AS (SELECT problem_id, x, sum(y) AS s, count(*) AS w FROM {v}_t GROUP BY problem_id, x),
{v}_c AS (SELECT *, row_number() OVER q AS i, sum(s) OVER q AS cs, sum(w) OVER q AS cw FROM {v}_u WINDOW q AS (PARTITION BY problem_id ORDER BY x)),
{v}_m AS (SELECT a.problem_id, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM {v}_c a JOIN {v}_c b ON a.problem_id = b.problem_id AND b.i >= a.i),
{v}_f AS (SELECT problem_id, x, max(low) AS fit FROM (
  SELECT c.problem_id, c.x, m.j, min(m.m) AS low FROM {v}_c c JOIN {v}_m m ON m.problem_id = c.problem_id AND m.j <= c.i AND m.k >= c.i GROUP BY c.problem_id, c.x, m.j) GROUP BY problem_id, x)"""


@register("calibrate_isotonic", sql=f"""WITH {", ".join(_sql_isotonic(v) for v in CAL)}
SELECT f1.problem_id, f1.sample_idx, {", ".join(f"round({v}_f.fit, 6) AS {v}" for v in CAL)} FROM f1
{" ".join(f"LEFT JOIN {v}_f ON {v}_f.problem_id = f1.problem_id AND {v}_f.x = f1.{v}" for v in CAL)}""")
def calibrate_isotonic(spark, sf):
    d = S.calibrate_isotonic(f1(spark, sf).select(*IDS, *CAL), CAL)
    return d.select(*IDS, *[r6(c, c) for c in CAL])


@register("calibrate_sigmoid")
def calibrate_sigmoid(spark, sf):
    d = S.calibrate_sigmoid(f1(spark, sf).select(*IDS, "rm_q", "rm_price"), ["rm_q", "rm_price"])
    return d.select(*IDS, r6("rm_q", "rm_q"), r6("rm_price", "rm_price"))
