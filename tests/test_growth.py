"""What grows no faster than the table: rows move once, not once per step."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pickwise.functions import whole
from pickwise.models import logistic as L
from pickwise.operators import grids, scores
from pickwise.operators.scaling import oracle_logistic_per_problem


def _scores(spark, sizes, seed=1):
    """Rows (problem_id, sample_idx, y, a, b) with missing scores, unknown labels and rows without a problem."""
    rng = np.random.default_rng(seed)
    rows = []
    for p, n in enumerate(sizes):
        for i in range(n):
            y = int(rng.random() < 0.5)
            a = None if rng.random() < 0.1 else float(y + rng.normal())
            rows.append((p if p else None, i, None if rng.random() < 0.05 else y, a, float(rng.integers(0, 2))))
    return spark.createDataFrame(rows, "problem_id long, sample_idx int, y int, a double, b double")


def test_shares_of_a_split_are_joined_once(spark, monkeypatch):
    """No Newton step of a split's fits joins the problems' places to the rows again (F7)."""
    plans = []
    passes = grids.Cells._passes

    def watched(self, names, body):
        plans.append(self.rows._jdf.queryExecution().optimizedPlan().toString())
        return passes(self, names, body)

    monkeypatch.setattr(grids.Cells, "_passes", watched)
    df = _scores(spark, [4] * 60).where("problem_id is not null and a is not null and y is not null")
    grids.Cells(df, ["a", "b"], [1, 2]).logistic(0.8)
    assert len(plans) > 3
    assert not any("Join" in p for p in plans)


def test_small_groups_are_fitted_whole(spark, monkeypatch):
    """Models of small groups equal those of a Spark job per step, and need no job per step (F8)."""
    df = _scores(spark, [3, 0, 1, 8, 40, 12, 5, 9, 30, 2, 17])
    wrote = []
    write = L.written
    monkeypatch.setattr(L, "written", lambda *a: (wrote.append(a[1]), write(*a))[1])

    def fits():
        return {r["problem_id"]: np.array(list(r)[1:], float) for r in L.logistic_fit(df, ["a", "b"], "problem_id", logit_adjust=True).collect()}

    got = fits()
    assert wrote == ["coefficients"]
    monkeypatch.setattr(whole, "GROUP_ROWS", 0)
    spread = fits()
    monkeypatch.setattr(whole, "GROUP_ROWS", 10)
    both = fits()
    assert None not in got and set(got) == set(spread) == set(both)
    for key, b in spread.items():
        np.testing.assert_allclose(got[key], b, atol=1e-8)
        np.testing.assert_allclose(both[key], b, atol=1e-8)


def test_groups_are_never_cut(spark, monkeypatch):
    """Every step gets whole groups, whatever the batches."""
    monkeypatch.setattr(whole, "STEP_ROWS", 7)
    df = spark.range(200).selectExpr("cast(id % 23 as string) as g", "cast(id as double) as x")

    def values(table, starts):
        sizes = np.diff(np.append(starts, len(table)))
        return [np.repeat(sizes, sizes).astype(float), np.repeat(np.add.reduceat(table["x"].to_numpy(), starts), sizes)]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = whole.with_whole(df, "g", ["n", "total"], values).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r["g"]: (r["n"], r["t"]) for r in df.groupBy("g").agg(F.sum("x").alias("t"), F.count("g").alias("n")).collect()}
    assert len(got) == 200
    assert all((r["n"], r["total"]) == want[r["g"]] for r in got)


def _same_rows(a, b, digits=9):
    def rows(df):
        return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    assert a.columns == b.columns
    assert a.dtypes == b.dtypes
    assert rows(a) == rows(b)


def test_isotonic_fits_of_small_problems_move_rows_once(spark, monkeypatch):
    """Small problems are fitted whole, without a sort of all scores, with the same values (F15)."""
    df = _scores(spark, [3, 1, 8, 40, 12, 5, 30, 2, 17]).withColumn("b", F.col("a") * 2 - F.col("b").cast("double"))
    df = df.withColumn("a", F.round("a", 0))        # equal scores
    monkeypatch.setattr(scores, "global_rank", None)
    whole_fits = scores.calibrate_isotonic(df, ["a", "b"])
    whole_fits.count()
    monkeypatch.undo()
    for most in (0, 10):
        monkeypatch.setattr(whole, "GROUP_ROWS", most)
        _same_rows(whole_fits, scores.calibrate_isotonic(df, ["a", "b"]))


def test_thresholds_of_small_problems_move_rows_once(spark, monkeypatch):
    """Small problems find their class-balance thresholds whole, with the same votes (F23)."""
    df = _scores(spark, [3, 1, 8, 40, 12, 5, 30, 2, 17]).withColumn("a", F.when(F.col("sample_idx") % 7 == 3, -1.0).otherwise(F.round("a", 1)))
    df = df.withColumn("y", F.when(F.col("problem_id") != 4, F.col("y")))
    monkeypatch.setattr(scores, "grouped_ranks", None)
    votes = scores.binarize_per_problem(df, ["a", "b"])
    votes.count()
    monkeypatch.undo()
    for most in (0, 10):
        monkeypatch.setattr(whole, "GROUP_ROWS", most)
        _same_rows(votes, scores.binarize_per_problem(df, ["a", "b"]))


def test_quantiles_of_small_problems_move_rows_once(spark, monkeypatch):
    """Small problems are mapped to their own quantiles whole, with the same levels (F19)."""
    df = _scores(spark, [3, 1, 8, 40, 12, 5, 30, 2, 17]).withColumn("a", F.round(F.col("a") * 3, 0))
    for normal in (False, True):
        monkeypatch.setattr(scores, "grouped_ranks", None)
        levels = scores._quantile_per_problem(df, ["a", "b"], 100, normal)
        levels.count()
        monkeypatch.undo()
        for most in (0, 10):
            monkeypatch.setattr(whole, "GROUP_ROWS", most)
            _same_rows(levels, scores._quantile_per_problem(df, ["a", "b"], 100, normal))
        monkeypatch.undo()


def test_oracles_per_problem_need_no_job_per_step(spark, monkeypatch):
    """One written table of coefficients for each k, none for each step (F11)."""
    wrote = []
    write = L.written
    monkeypatch.setattr(L, "written", lambda *a: (wrote.append(a[1]), write(*a))[1])
    df = _scores(spark, [4, 6, 2, 8, 5, 4]).where("problem_id is not null and a is not null and y is not null")
    df = df.withColumn("sample_idx", (F.row_number().over(Window.partitionBy("problem_id").orderBy("sample_idx")) - 1).cast("int"))
    got = {r["k"]: r["accuracy"] for r in oracle_logistic_per_problem(df, ["a", "b"], [2, 4]).collect()}
    assert wrote == ["coefficients"] * 2
    monkeypatch.setattr(whole, "GROUP_ROWS", 0)
    assert got == {r["k"]: r["accuracy"] for r in oracle_logistic_per_problem(df, ["a", "b"], [2, 4]).collect()}
