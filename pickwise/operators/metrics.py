"""Selection and evaluation metrics (per problem, then averaged).

Per-problem choices are aggregates, not ranking windows: the chosen row is the maximum
of a struct ``(score, -sample_idx, ...)``, so a problem with millions of samples is
reduced where its rows lie and only one partial row per problem and task is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import flag, safe_div, sum_cols
from pickwise.functions.joins import join_back
from pickwise.functions.topk import group_topk

NO_ANSWER = "NO_ANSWER"


def _top_key(score):
    return F.struct(F.col(score), -F.col("sample_idx"))


# ---------------------------------------------------------------- 91-95

def _metric_table(scored: DataFrame, score: str, by, top1: bool = True, sample: bool = True,
                  prediction: bool = True) -> DataFrame:
    """Per problem, in one grouped aggregate with partial aggregation.

    The chosen row is the maximum of a struct (score, -sample_idx, payload): every task sends one
    partial row per problem, so a problem that holds a third of all samples is combined where
    its rows lie and no row is shuffled or joined back.  A problem without any score has no
    chosen row."""
    by = list(by)
    p1 = F.col(score)
    p0 = F.lit(1.0) - p1
    s = scored.select(*by, "sample_idx", "y", p1.alias("__p1"), F.greatest(p0, p1).alias("__best"),
                      F.when(p1 > p0, 1).otherwise(0).alias("__cls"))
    pred, y = F.col("__cls") == 1, F.col("y")

    def best(value, *payload):
        return F.max(F.when(F.col(value).isNotNull(), F.struct(
            F.col(value).alias("value"), (-F.col("sample_idx")).alias("back"), *[F.col(c) for c in payload])))

    aggs = [F.max("y").alias("has_positive")]
    if top1:
        aggs.append(best("__p1", "y").alias("__top"))
    if sample:
        aggs += [F.avg(flag(pred == (y == 1))).alias("sample_accuracy"),
                 F.count_if(pred & (y == 1)).alias("sample_tp"), F.count_if(~pred & (y == 0)).alias("sample_tn"),
                 F.count_if(pred & (y == 0)).alias("sample_fp"), F.count_if(~pred & (y == 1)).alias("sample_fn"),
                 F.count(F.lit(1)).alias("num_samples"), F.avg("y").alias("class_balance")]
    if prediction:
        aggs.append(best("__best", "__cls", "y").alias("__pre"))
    t = s.groupBy(*by).agg(*aggs)
    out = [F.col(c) for c in t.columns if c not in ("__top", "__pre")]
    if top1:
        out += [(-F.col("__top.back")).alias("top1_idx"), F.col("__top.y").alias("top1_label")]
    if prediction:
        out += [(-F.col("__pre.back")).alias("prediction_idx"), F.col("__pre.__cls").alias("prediction_class"), F.col("__pre.y").alias("__plab")]
    return t.select(*out)


def _top1_cols():
    lab, pos = F.col("top1_label"), F.col("has_positive")
    return [F.col("top1_idx").cast("int").alias("top1_idx"), lab.cast("int").alias("top1_label"),
            pos.cast("int").alias("has_positive"), flag(lab == 1).alias("top1_positive"),
            flag((lab == 1) & (pos == 1)).alias("top1_tp"), flag((lab == 1) & (pos == 0)).alias("top1_fp"),
            flag((lab == 0) & (pos == 0)).alias("top1_tn"), flag((lab == 0) & (pos == 1)).alias("top1_fn")]


def _pred_cols():
    c, lab = F.col("prediction_class"), F.col("__plab")
    return [F.col("prediction_idx").cast("int").alias("prediction_idx"), c.cast("int").alias("prediction_class"),
            flag(c == lab).alias("prediction_accuracy"), flag((c == 1) & (lab == 1)).alias("prediction_tp"),
            flag((c == 0) & (lab == 0)).alias("prediction_tn"), flag((c == 1) & (lab == 0)).alias("prediction_fp"),
            flag((c == 0) & (lab == 1)).alias("prediction_fn")]


SAMPLE_COLS = ["sample_accuracy", "sample_tp", "sample_tn", "sample_fp", "sample_fn", "num_samples"]


def select_top1(df: DataFrame, score: str = "p1", by=("problem_id",)) -> DataFrame:
    """Sample with max ``score`` per problem (lowest sample_idx on ties): its label,
    has_positive, tp/fp/tn/fn (fp is always 0, Q1)."""
    t = _metric_table(df, score, by, top1=True, sample=False, prediction=False)
    return t.select(*by, *_top1_cols())


def sample_metrics(df: DataFrame, score: str = "p1", by=("problem_id",)) -> DataFrame:
    """Per problem over its samples: predicted class 1 iff p1 > p0 = 1 - p1 (class 0 on ties)."""
    pred = F.col(score) > (F.lit(1.0) - F.col(score))
    y = F.col("y")
    return df.groupBy(*by).agg(
        F.avg(flag(pred == (y == 1))).alias("sample_accuracy"),
        F.count_if(pred & (y == 1)).alias("sample_tp"),
        F.count_if(~pred & (y == 0)).alias("sample_tn"),
        F.count_if(pred & (y == 0)).alias("sample_fp"),
        F.count_if(~pred & (y == 1)).alias("sample_fn"),
        F.count(F.lit(1)).alias("num_samples"))


def prediction_metrics(df: DataFrame, score: str = "p1", by=("problem_id",)) -> DataFrame:
    """Most confident (sample, class) cell: row-major argmax over [p0, p1] (lowest sample, then
    class 0, on ties)."""
    t = _metric_table(df, score, by, top1=False, sample=False, prediction=True)
    return t.select(*by, *_pred_cols())


def problem_results(scored: DataFrame, score: str = "p1", set_col: str | None = None) -> DataFrame:
    """Top-1, sample and prediction metrics of every problem from one metric table."""
    by = ("problem_id",) if set_col is None else (set_col, "problem_id")
    t = _metric_table(scored, score, by)
    return t.select(*by, *_top1_cols(), *SAMPLE_COLS, "class_balance", *_pred_cols())


def assemble_results(scored: DataFrame, split: DataFrame, score: str = "p1") -> DataFrame:
    """One row per (set, problem): chosen sample, metrics, difficulty bin and the problem's
    class balance.  ``split``: (problem_id, difficulty, set)."""
    res = problem_results(scored, score)
    return (res.join(split, "problem_id")
            .select("set", "problem_id", "top1_idx", "top1_positive", "sample_accuracy", "prediction_idx",
                    "prediction_accuracy", "difficulty", "class_balance"))


def summary(results: DataFrame, set_col: str = "set") -> DataFrame:
    """Per set: problems, select / sample / top-1 accuracy and summed counts."""
    s = lambda c: F.sum(c).cast("bigint")
    tp, tn, fp, fn = (F.sum(f"top1_{k}") for k in ("tp", "tn", "fp", "fn"))
    return results.groupBy(set_col).agg(
        F.count(F.lit(1)).alias("n_problems"),
        F.avg("top1_positive").alias("select_acc"),
        F.avg("sample_accuracy").alias("sample_acc"),
        safe_div(tp + tn, tp + tn + fp + fn).alias("top1_acc"),
        s("top1_tp").alias("select_tp"), s("top1_tn").alias("select_tn"),
        s("top1_fp").alias("select_fp"), s("top1_fn").alias("select_fn"),
        s("sample_tp").alias("sample_tp"), s("sample_tn").alias("sample_tn"),
        s("sample_fp").alias("sample_fp"), s("sample_fn").alias("sample_fn"))


def summary_by_difficulty(results: DataFrame, set_col: str = "set", bin_col: str = "difficulty") -> DataFrame:
    """Per difficulty bin: train and test side by side (full outer join of two grouped aggregates)."""
    def side(name):
        r = results.filter(F.col(set_col) == name)
        return r.groupBy(bin_col).agg(
            F.count(F.lit(1)).alias(f"{name}_problems"),
            F.avg("top1_positive").alias(f"{name}_select_acc"),
            F.avg("sample_accuracy").alias(f"{name}_sample_acc"),
            (F.sum("top1_tp") + F.sum("top1_tn")).cast("double").alias("__hits"))\
            .withColumn(f"{name}_top1_acc", F.col("__hits") / F.col(f"{name}_problems")).drop("__hits")
    return side("train").join(side("test"), bin_col, "full_outer")


# ---------------------------------------------------------------- pass@k

def pass_at_k(df: DataFrame, ks) -> DataFrame:
    """Share of problems with a correct sample among the first k, per k.

    Only problems with at least k samples take part (rectangle rule)."""
    g = df.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.when(F.col("sample_idx") < k, F.col("y"))).alias(f"h{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hit"), F.col("n")) for k in ks]))
    return (g.select(rows.alias("r")).select("r.*").filter(F.col("n") >= F.col("k"))
            .groupBy("k").agg(F.avg("hit").alias("pass_at_k")))


def pass_at_k_unbiased(df: DataFrame, ks, max_samples: int | None = None) -> DataFrame:
    """1 - C(n-c,k)/C(n,k) per problem, averaged; n = samples used (first ``max_samples``)."""
    d = df if max_samples is None else df.filter(F.col("sample_idx") < max_samples)
    g = d.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("c"))
    rows = g.select("n", "c", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter(F.col("k") <= F.col("n"))
    n, c, k = F.col("n"), F.col("c"), F.col("k")
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - k.cast("double") / i))
    est = F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(F.lit(1.0) - prod)
    return rows.groupBy("k").agg(F.avg(est).alias("pass_at_k"))


# ---------------------------------------------------------------- majority

def answer_table(df: DataFrame, answer: str = "answer", skip_no_answer: bool = True) -> DataFrame:
    """(problem_id, answer) -> count, correct count, first sample index and its label."""
    d = df.filter(~F.col(answer).eqNullSafe(NO_ANSWER)) if skip_no_answer else df
    return d.groupBy("problem_id", answer).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("y").alias("n_correct"),
        F.min("sample_idx").alias("first_idx"), F.min_by("y", "sample_idx").alias("first_y"))


def majority_vote(df: DataFrame, k: int = 1, mode: str = "majority", answer: str = "answer",
                  skip_no_answer: bool = True) -> DataFrame:
    """Top-k answers by count (ties: first appearance); NULL is an answer, 'NO_ANSWER' skipped.

    ``majority``: correct if a top-k answer has more than half of its samples correct;
    ``one_sample``: correct if the first sample of a top-k answer is correct.
    ``majority_idx`` is the first sample of the answer that scored, else of the top answer (Q2).
    Problems with no answer left are not reported (Q3).
    """
    at = answer_table(df, answer, skip_no_answer)
    hit = (F.col("n_correct") > F.col("cnt") / 2.0) if mode == "majority" else (F.col("first_y") == 1)
    if k == 1:
        g = at.groupBy("problem_id").agg(F.max_by(
            F.struct(F.col("first_idx"), hit.alias("hit")),
            F.struct(F.col("cnt"), -F.col("first_idx"))).alias("t"))
        return g.select("problem_id", flag(F.col("t.hit")).alias("majority_correct"),
                        F.col("t.first_idx").cast("int").alias("majority_idx"))
    # salted two-stage top-k: a problem with very many distinct answers is ranked by many tasks
    top = group_topk(at, ["problem_id"], [F.col("cnt").desc(), F.col("first_idx")], k, salt_col="first_idx")
    g = top.groupBy("problem_id").agg(
        F.min_by("first_idx", F.when(hit, F.col("rk")).otherwise(F.col("rk") + k)).alias("idx"),
        F.max(flag(hit)).alias("majority_correct"))
    return g.select("problem_id", F.col("majority_correct").cast("int").alias("majority_correct"),
                    F.col("idx").cast("int").alias("majority_idx"))


def _majority_columns(df: DataFrame, ks, mode: str, answer: str, no_answer: str) -> DataFrame:
    """(k, majority_at_k) for the top answer: sums per answer hold plain numbers, no row is copied or joined."""
    none = F.col(answer).eqNullSafe(NO_ANSWER)
    parts = [F.count(F.lit(1)).alias("c")]
    for k in ks:
        inside = F.col("sample_idx") < k
        parts += [F.count_if(inside).alias(f"n{k}"), F.min(F.when(inside, F.col("sample_idx"))).alias(f"f{k}"),
                  F.sum(F.when(inside, F.col("y"))).alias(f"y{k}") if mode == "majority" else F.min_by("y", F.when(inside, F.col("sample_idx"))).alias(f"y{k}")]
    at = df.where("problem_id is not null").groupBy("problem_id", answer).agg(*parts)
    tops = []
    for k in ks:
        n, first, y = F.col(f"n{k}"), F.col(f"f{k}"), F.col(f"y{k}")
        hit = y > n / 2.0 if mode == "majority" else y == 1
        tops.append(F.max(F.when((n > 0) & ~none, F.struct(n.alias("n"), (-first).alias("back"), flag(hit).alias("hit")))).alias(f"t{k}"))
        tops.append(F.max(none & (n > 0)).alias(f"none{k}"))
    per = at.groupBy("problem_id").agg(F.sum("c").alias("size"), *tops)

    def counted(k):
        hit = F.when(F.col("size") >= k, F.col(f"t{k}.hit"))
        if no_answer == "error":
            hit = F.when((F.col("size") >= k) & F.col(f"none{k}"), F.raise_error(F.lit("a sample without an answer takes part in the vote")).cast("int")).otherwise(hit)
        return F.avg(hit)

    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("majority_at_k")) for k in ks]))
    return per.agg(*[counted(k).alias(f"a{k}") for k in ks]).select(rows.alias("r")).select("r.*").where("majority_at_k is not null")


def majority_at_k(df: DataFrame, ks, top_m: int = 1, mode: str = "majority", answer: str = "answer", no_answer: str = "skip") -> DataFrame:
    """Majority vote over the first k samples with the top-M answers, accuracy per k, over the
    problems with at least k samples.  One scan: for the top answer alone the ks are columns of one aggregate per
    answer and one per problem, for more answers a sample opens into the ks that it counts for.

    ``no_answer``: 'skip' leaves samples marked 'NO_ANSWER' out of the vote; 'error' fails the query
    when one of them would vote."""
    if no_answer not in ("skip", "error"):
        raise ValueError(f"no_answer must be skip or error, not {no_answer}")
    if top_m == 1:
        return _majority_columns(df, sorted(set(ks)), mode, answer, no_answer)
    n = df.groupBy("problem_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = join_back(df.select("problem_id", "sample_idx", "y", answer), n, "problem_id")
    fits = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: (F.col("sample_idx") < k) & (F.col("__n") >= k))
    if no_answer == "error":
        voting = (F.size(fits) > 0) & F.col(answer).eqNullSafe(NO_ANSWER)
        rows = rows.withColumn(answer, F.when(voting, F.raise_error(F.lit("a sample without an answer takes part in the vote"))).otherwise(F.col(answer)))
    opened = rows.select("problem_id", "sample_idx", "y", answer, F.explode(fits).alias("k"))
    mv = majority_vote(opened.withColumn("problem_id", F.struct("k", "problem_id")), top_m, mode, answer)
    return mv.groupBy(F.col("problem_id.k").alias("k")).agg(F.avg("majority_correct").alias("majority_at_k"))


def majority_top1(df: DataFrame, only_solvable: bool = False, answer: str = "answer") -> DataFrame:
    """Most common answer (first seen on ties, NULL counts) correct if > half its samples are."""
    d = _solvable(df) if only_solvable else df
    mv = majority_vote(d, 1, "majority", answer, skip_no_answer=False)
    return mv.agg(F.sum("majority_correct").cast("bigint").alias("correct"),
                  F.count(F.lit(1)).alias("total"),
                  F.avg("majority_correct").alias("accuracy"))


def _solvable(df):
    ok = df.groupBy("problem_id").agg(F.max("y").alias("__m")).filter(F.col("__m") == 1).select("problem_id")
    return df.join(ok, "problem_id", "left_semi")


# ---------------------------------------------------------------- selection accuracies

def selection_at_1(df: DataFrame, score: str, only_solvable: bool = False) -> DataFrame:
    d = _solvable(df) if only_solvable else df
    return select_top1(d, score).agg(F.avg("top1_label").alias("accuracy"), F.count(F.lit(1)).alias("total"))


def first_sample_accuracy(df: DataFrame, only_solvable: bool = False) -> DataFrame:
    d = _solvable(df) if only_solvable else df
    return d.filter(F.col("sample_idx") == 0).agg(F.avg("y").alias("accuracy"), F.count(F.lit(1)).alias("total"))


def answerable_counts(df: DataFrame) -> DataFrame:
    g = df.groupBy("problem_id").agg(F.max("y").alias("m"))
    return g.agg(F.count_if(F.col("m") == 1).alias("answerable"), F.count(F.lit(1)).alias("total"))


def coverage(df: DataFrame) -> DataFrame:
    """Oracle selection: a problem is solved if any sample is correct."""
    return df.groupBy("problem_id").agg(F.max("y").cast("int").alias("coverage"))


def first_sample(df: DataFrame) -> DataFrame:
    """Choose sample 0 per problem; sample counts as in the reference (tp = positives, tn = negatives)."""
    return df.groupBy("problem_id").agg(
        F.max(F.when(F.col("sample_idx") == 0, F.col("y"))).cast("int").alias("top1_positive"),
        F.count_if(F.col("y") == 1).alias("sample_tp"), F.count_if(F.col("y") == 0).alias("sample_tn"))


def evaluation_report(df: DataFrame, scorer: str, ensemble: list[str] | None = None,
                      only_solvable: bool = False) -> DataFrame:
    """One table of (metric, value): scorer selection@1, first sample, majority@1,
    ensemble selection@1, answerable and total problems."""
    parts = [selection_at_1(df, scorer, only_solvable).select(F.lit("selection_at_1").alias("metric"),
                                                              F.col("accuracy").alias("value")),
             first_sample_accuracy(df, only_solvable).select(F.lit("first_sample").alias("metric"),
                                                             F.col("accuracy").alias("value")),
             majority_top1(df, only_solvable).select(F.lit("majority_at_1").alias("metric"),
                                                     F.col("accuracy").alias("value"))]
    if ensemble:
        ens = df.withColumn("__ens", sum_cols(ensemble) / F.lit(float(len(ensemble))))
        parts.append(selection_at_1(ens, "__ens", only_solvable).select(
            F.lit("ensemble_selection_at_1").alias("metric"), F.col("accuracy").alias("value")))
    ac = answerable_counts(df)
    parts.append(ac.select(F.lit("answerable").alias("metric"), F.col("answerable").cast("double").alias("value")))
    parts.append(ac.select(F.lit("total_problems").alias("metric"), F.col("total").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _long(df, verifiers):
    """Wide -> long (problem_id, sample_idx, y, verifier, score) with one explode (no shuffle)."""
    return df.select("problem_id", "sample_idx", "y", F.explode(F.array(*[
        F.struct(F.lit(v).alias("verifier"), F.lit(i).alias("pos"), F.col(v).alias("score"))
        for i, v in enumerate(verifiers)])).alias("s")) \
        .select("problem_id", "sample_idx", "y", "s.verifier", "s.pos", "s.score")


def verifier_top1(df: DataFrame, verifiers) -> DataFrame:
    """Per (verifier, problem): label of the verifier's own top sample (ties: lowest sample_idx;
    a missing score ranks below every present one).  The verifiers are columns of one aggregate per problem."""
    tops = [F.max_by("y", F.struct(F.col(v).isNotNull(), F.col(v), -F.col("sample_idx"))).cast("int").alias(f"t{i}") for i, v in enumerate(verifiers)]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("verifier"), F.lit(i).alias("pos"), F.col(f"t{i}").alias("top1_label"))
                               for i, v in enumerate(verifiers)]))
    return df.groupBy("problem_id").agg(*tops).select("problem_id", each.alias("s")).select("s.verifier", "s.pos", "problem_id", "s.top1_label")


def best_verifier(df: DataFrame, verifiers) -> DataFrame:
    """Max over verifiers of the selection accuracy of the verifier's own top sample
    (the first verifier in list order on ties)."""
    acc = verifier_top1(df, verifiers).groupBy("verifier", "pos").agg(F.avg("top1_label").alias("accuracy"))
    return acc.agg(F.max("accuracy").alias("best_verifier_accuracy"),
                   F.max_by("verifier", F.struct("accuracy", -F.col("pos"))).alias("best_verifier"))


def selection_at_k(df: DataFrame, score: str, ks) -> DataFrame:
    """Accuracy of the top score among the first k samples, per k (problems with >= k samples).
    One grouped aggregate with a column per k; nothing is joined."""
    key = F.struct(F.col(score).alias("value"), (-F.col("sample_idx")).alias("back"), F.col("y"))
    best = [F.max(F.when((F.col("sample_idx") < k) & F.col(score).isNotNull(), key)).alias(f"b{k}") for k in ks]
    per = df.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), *best)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}.y").alias("label")) for k in ks]))
    return per.select("n", rows.alias("r")).where("n >= r.k").groupBy(F.col("r.k").alias("k")).agg(F.avg("r.label").alias("accuracy"))


def ensemble_at_k(df: DataFrame, verifiers, ks) -> DataFrame:
    ens = df.withColumn("__ens", sum_cols(verifiers) / F.lit(float(len(verifiers))))
    return selection_at_k(ens, "__ens", ks)


def verifier_f1(df: DataFrame, verifiers) -> DataFrame:
    """F1 of (score >= 0.5) against y with 1e-8 guards, per verifier."""
    lg = _long(df, verifiers)
    pred, y = F.col("score") >= 0.5, F.col("y")
    g = lg.groupBy("verifier").agg(F.count_if(pred & (y == 1)).alias("tp"),
                                   F.count_if(pred & (y == 0)).alias("fp"),
                                   F.count_if(~pred & (y == 1)).alias("fn"))
    p = F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(1e-8))
    r = F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(1e-8))
    return g.select("verifier", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
                    (F.lit(2.0) * p * r / (p + r + F.lit(1e-8))).alias("f1"))


def verifier_top1_score(df: DataFrame, verifiers) -> DataFrame:
    """From top-1 hits h and misses m per verifier: the formula as written
    0.5*(h/(2h+e))*(m/(m+h+e)) (Q4) and the balanced form 0.5*(h/(h+m+e) + ...)."""
    t = verifier_top1(df, verifiers).groupBy("verifier").agg(
        F.sum("top1_label").cast("double").alias("h"), F.sum(F.lit(1) - F.col("top1_label")).cast("double").alias("m"))
    h, m, e = F.col("h"), F.col("m"), F.lit(1e-8)
    return t.select("verifier", h.cast("bigint").alias("hits"), m.cast("bigint").alias("misses"),
                    (F.lit(0.5) * (h / (h + h + e)) * (m / (m + h + e))).alias("score_as_written"),
                    (h / (h + m + e)).alias("hit_rate"))


def random_baseline(df: DataFrame) -> DataFrame:
    """Accuracy of a random choice: mean over problems of mean(y)."""
    per = df.groupBy("problem_id").agg(F.avg("y").alias("acc"))
    return per.agg(F.avg("acc").alias("random_accuracy"), F.count(F.lit(1)).alias("n_problems"))


def generation_gap(df: DataFrame, score: str) -> DataFrame:
    """Oracle coverage minus achieved selection accuracy."""
    top = select_top1(df, score)
    return top.agg(F.avg("has_positive").alias("coverage"), F.avg("top1_label").alias("selection_accuracy"),
                   (F.avg("has_positive") - F.avg("top1_label")).alias("generation_gap"))


def sweep_summary(runs: DataFrame, by) -> DataFrame:
    """Mean and sample sd of test accuracy by configuration columns."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"),
                                 F.avg("test_select_accuracy").alias("mean_accuracy"),
                                 F.stddev_samp("test_select_accuracy").alias("sd_accuracy"))
