"""Shared steps that read the samples once: splits, tops of every verifier, majority votes per k."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from pickwise.operators.metrics import majority_at_k, verifier_top1
from pickwise.operators.sampling import difficulty_bins, stratified_split


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_split_keeps_its_problems(spark):
    """The split's rows come from the kept table of problems; every use of it would else group all samples again."""
    d = spark.range(400).select((F.col("id") % 100).alias("problem_id"), (F.col("id") / 100).cast("int").alias("sample_idx"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    split = stratified_split(d, 0.8, 42, 4)
    assert "InMemoryTableScan" in plan_of(split)
    n = {(r["difficulty"], r["set"]): r["n"] for r in split.groupBy("difficulty", "set").agg(F.count(F.lit(1)).alias("n")).collect()}
    for g, total in ((r["difficulty"], r["n"]) for r in difficulty_bins(d, 4).groupBy("difficulty").agg(F.count(F.lit(1)).alias("n")).collect()):
        assert n.get((g, "train"), 0) == int(0.8 * total)
        assert n.get((g, "train"), 0) + n.get((g, "test"), 0) == total


VOTES = [(1, 0, 1, "a", 0.1, None), (1, 1, 0, "b", 0.9, None), (1, 2, 0, "b", 0.9, None), (2, 0, 1, "NO_ANSWER", None, 1.0), (2, 1, 1, None, 0.5, 1.0), (2, 2, 0, "a", 0.5, 2.0),
         (3, 0, 0, "NO_ANSWER", 1.0, 1.0), (4, 0, 1, "a", 1.0, float("nan")), (4, 1, None, "a", 2.0, 3.0), (None, 0, 1, "a", 1.0, 1.0)]
SCHEMA = "problem_id long, sample_idx int, y int, answer string, u double, v double"


def test_tops_of_verifiers_open_no_row_per_verifier(spark):
    d = spark.createDataFrame(VOTES, SCHEMA)
    out = verifier_top1(d, ["u", "v"])
    got = {(r["verifier"], r["pos"], r["problem_id"]): r["top1_label"] for r in out.collect()}
    assert got == {("u", 0, 1): 0, ("u", 0, 2): 1, ("u", 0, 3): 0, ("u", 0, 4): None, ("u", 0, None): 1,
                   ("v", 1, 1): 1, ("v", 1, 2): 0, ("v", 1, 3): 0, ("v", 1, 4): 1, ("v", 1, None): 1}
    lines = plan_of(out).splitlines()
    assert min(i for i, x in enumerate(lines) if "Generate" in x) < min(i for i, x in enumerate(lines) if "Aggregate" in x)


def test_majority_at_k_copies_and_joins_no_row(spark):
    d = spark.createDataFrame(VOTES, SCHEMA)
    out = majority_at_k(d, [1, 2, 3, 4])
    plan = plan_of(out)
    assert "Join" not in plan and plan.count("Generate") == 1
    # k=1: problem 1 right, 2 and 3 without an answer, 4 right; k=2: 1 right (first on ties), 2 right (null is an answer),
    # 4 one of two labels right; k=3: 1 wrong (b), 2 right; k=4: no problem has as many
    assert {r["k"]: round(r["majority_at_k"], 6) for r in out.collect()} == {1: 1.0, 2: round(2 / 3, 6), 3: 0.5}
    one = {r["k"]: round(r["majority_at_k"], 6) for r in majority_at_k(d, [1, 2, 3], mode="one_sample").collect()}
    assert one == {1: 1.0, 2: 1.0, 3: 0.5}


def test_mixture_step_passes_once_over_the_samples(spark, monkeypatch):
    """Of a step's passes over the samples, the one for the likelihoods ran twice: for the objective and for the next step."""
    from pickwise.models import mixture

    d = spark.range(600).select((F.col("id") % 120).alias("problem_id"), (F.col("id") % 7 < 3).cast("int").alias("y"), (F.col("id") % 11 / 11.0).alias("u"))
    seen = []
    monkeypatch.setattr(mixture, "written", lambda df, label, f=mixture.written: seen.append(df.columns) or f(df, label))
    model = mixture.mixture_fit(d, ["u"], k=2, max_iter=2, tol=0.0)
    assert [c for c in seen if "__lse" in c] == [["problem_id", "r0", "r1", "__lse"]] * 2
    assert len(seen) == 3 and model["beta"].shape == (2, 2)


def counted(spark, df, column: str):
    """``df`` whose ``column`` counts how often its rows are made, and that count."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    return df.withColumn(column, seen.asNondeterministic()(column)), made


def test_scorer_fit_makes_its_pairs_once(spark):
    """Word weights, statistics, rows and summary of the regression each made the pairs anew."""
    from pickwise.operators.distill import distilled_scorer_fit, distilled_scorer_score

    pairs = spark.createDataFrame([("which one", f"word{i % 7} end", float(i % 7 > 3) if i else None) for i in range(60)], "instruction string, response string, label double")
    watched, made = counted(spark, pairs, "response")
    model = distilled_scorer_fit(watched, num_features=256)
    assert made.value == 60
    got = distilled_scorer_score(model, pairs).collect()
    assert len(got) == 60 and all(abs(r["prediction"] - r["label"]) < 0.1 for r in got if r["label"] is not None)


def test_pairs_are_numbered_from_kept_rows(spark):
    from pickwise.operators.distill import pair_table

    lists = spark.createDataFrame([(i, "ask", [f"a{i}", "b"], [float(i), 1.0]) for i in (5, 3, 9)], "problem_id long, instruction string, samples array<string>, u_scores array<double>")
    watched, made = counted(spark, lists, "instruction")
    got = pair_table([(watched, ["u_scores"])]).orderBy("problem_idx", "sample_idx").collect()
    assert made.value <= 6          # once for each pair, or for each list
    assert [(r["source"], r["problem_idx"], r["sample_idx"], r["response"], r["label"]) for r in got] == [
        (0, i, s, t, x) for i, p in enumerate((3, 5, 9)) for s, t, x in ((0, f"a{p}", float(p)), (1, "b", 1.0))]


def test_predictions_of_a_mixture_join_no_row_back(spark):
    """Rows went apart from their predictions and were joined to them again by a number."""
    from pickwise.models.gaussian import gmm_fit, gmm_predict

    rows = [(g, i, [float(i % 2 * 4) + 0.01 * i, float(i % 3)], i % 2, f"t{i}") for g in ("a", "b") for i in range(12)]
    df = spark.createDataFrame(rows, "g string, i int, vec array<double>, __init int, word string")
    params = gmm_fit(df, "vec", 2, "g", reg=0.01, max_iter=3, tol=1.0)
    asked = df.drop("__init").unionByName(spark.createDataFrame([(None, 90, [0.0, 0.0], "n"), ("c", 91, [0.0, 0.0], "c")], "g string, i int, vec array<double>, word string"))
    got = gmm_predict(asked, params, "vec", "g")
    assert got.columns == ["g", "i", "vec", "word", "cluster_id"] and "LeftOuter" not in plan_of(got)
    assert sorted(((r["g"] or "", r["i"], r["word"], r["cluster_id"]) for r in got.collect()), key=str) == sorted(
        [(g, i, w, k) for g, i, _, k, w in rows] + [("", 90, "n", None), ("c", 91, "c", None)], key=str)
