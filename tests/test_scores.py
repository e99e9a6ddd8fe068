"""Score repair / normalisation / binarisation on hand-made rows."""

import numpy as np
import pytest

from pickwise.operators import scores as S


def frame(spark, rows, cols):
    """Rows -> DataFrame; ids are BIGINT / INT, y INT, answers STRING, everything else DOUBLE."""
    types = {"problem_id": "bigint", "sample_idx": "int", "y": "int", "answer": "string"}
    schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in cols)
    fixed = [tuple(float(v) if (types.get(c, "double") == "double" and v is not None) else v
                   for c, v in zip(cols, r)) for r in rows]
    return spark.createDataFrame(fixed, schema)


def test_minmax_gate_and_constant(spark):
    # v_big spans 10..30 -> normalised; v_in stays (inside [0,1]); v_vote stays (discrete);
    # v_const is constant outside [0,1] -> NULL (Q7)
    rows = [(1, 0, 1, 10.0, 0.2, -1.0, 5.0), (1, 1, 0, 20.0, 0.4, 1.0, 5.0), (2, 0, 1, 30.0, 0.9, 0.0, 5.0)]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v_big", "v_in", "v_vote", "v_const"])
    out = S.minmax_all(df, ["v_big", "v_in", "v_vote", "v_const"]).orderBy("problem_id", "sample_idx").toPandas()
    assert out["v_big"].tolist() == [0.0, 0.5, 1.0]
    assert out["v_in"].tolist() == [0.2, 0.4, 0.9]
    assert out["v_vote"].tolist() == [-1.0, 1.0, 0.0]
    assert out["v_const"].isna().all()


def test_minmax_per_problem_constant_falls_back_to_global(spark):
    rows = [(1, 0, 1, 10.0), (1, 1, 0, 10.0), (2, 0, 1, 5.0), (2, 1, 0, 25.0)]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v"])
    out = S.minmax_per_problem(df, ["v"]).orderBy("problem_id", "sample_idx").toPandas()
    assert out["v"].tolist() == pytest.approx([0.25, 0.25, 0.0, 1.0])


def test_binarize_keeps_abstain_and_negate_twice(spark):
    rows = [(1, 0, 1, -1.0), (1, 1, 0, 0.7), (1, 2, 0, 0.2)]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v"])
    b = S.binarize_fixed(df, ["v"], 0.5).orderBy("sample_idx").toPandas()
    assert b["v"].tolist() == [-1.0, 1.0, 0.0]
    n = S.negate_verifier(df, ["v"])
    nn = S.negate_verifier(n.drop("v").withColumnRenamed("~v", "v"), ["v"]).orderBy("sample_idx").toPandas()
    assert nn["~v"].tolist() == pytest.approx([-1.0, 0.7, 0.2])


@pytest.mark.parametrize("w", [2, 3, 4, 5])
def test_smoothing_matches_numpy_convolve(spark, w):
    rng = np.random.default_rng(w)
    rows = []
    for p in range(3):
        for i in range(7):
            rows.append((p, i, 0, float(rng.random())))
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v"])
    out = S.smooth_scores(df, ["v"], w).orderBy("problem_id", "sample_idx").toPandas()
    for p in range(3):
        x = np.array([r[3] for r in rows if r[0] == p])
        want = np.convolve(x, np.ones(w) / w, mode="same")
        got = out[out.problem_id == p]["v"].to_numpy()
        assert got == pytest.approx(want)


def test_smoothing_missing_in_window_is_missing(spark):
    rows = [(1, 0, 0, 1.0), (1, 1, 0, None), (1, 2, 0, 1.0), (1, 3, 0, 1.0), (1, 4, 0, 1.0)]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v"])
    got = S.smooth_scores(df, ["v"], 3).orderBy("sample_idx").toPandas()["v"].tolist()
    assert np.isnan(got[0]) and np.isnan(got[1]) and np.isnan(got[2])
    assert got[3] == pytest.approx(1.0) and got[4] == pytest.approx(2.0 / 3)


def test_interpolation_nearest_two(spark):
    rows = [(1, 0, 0, None, 0.2, 0.8, None)]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "a", "b", "c", "d"])
    out = S.interpolate_missing(df, ["a", "b", "c", "d"]).toPandas().iloc[0]
    # a at 0: nearest b (d=1), c (d=2)
    wa = np.array([1 / (1 + 1e-6), 1 / (2 + 1e-6)])
    assert out["a"] == pytest.approx((0.2 * wa[0] + 0.8 * wa[1]) / wa.sum())
    # d at 3: nearest c (d=1), b (d=2)
    assert out["d"] == pytest.approx((0.8 * wa[0] + 0.2 * wa[1]) / wa.sum())


def test_binarize_class_balance_threshold(spark):
    # cb = 0.25, 8 non-abstain scores -> rank ceil(0.75 * 8) = 6 -> threshold = 6th smallest
    scores = [0.1, 0.9, 0.3, 0.7, 0.5, 0.2, 0.8, 0.4, -1.0]
    ys = [0, 1, 0, 0, 0, 0, 1, 0, 0]
    rows = [(i // 3, i % 3, y, s) for i, (s, y) in enumerate(zip(scores, ys))]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v"])
    cb = np.mean(ys)
    nonab = sorted(s for s in scores if s != -1)
    t = nonab[int(np.ceil((1 - cb) * len(nonab))) - 1]
    out = S.binarize_class_balance(df, ["v"]).orderBy("problem_id", "sample_idx").toPandas()
    want = [-1.0 if s == -1 else float(s >= t) for s in scores]
    assert out["v"].tolist() == want


def test_binarize_per_problem_marks_enough(spark):
    rng = np.random.default_rng(1)
    rows = []
    for p in range(5):
        ys = rng.integers(0, 2, 6)
        for i in range(6):
            rows.append((p, i, int(ys[i]), float(rng.random())))
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v"])
    out = S.binarize_per_problem(df, ["v"]).toPandas()
    for p in range(5):
        sub = out[out.problem_id == p]
        cb = sub["y"].mean()
        assert sub["v"].sum() >= np.ceil(cb * len(sub)) - 1e-9


def test_majority_verifier_scaling(spark):
    rows = [(1, 0, 0, "a"), (1, 1, 0, "a"), (1, 2, 0, "b"), (1, 3, 0, None), (2, 0, 0, "x")]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "answer"])
    out = S.majority_verifier(df).orderBy("problem_id", "sample_idx").toPandas()["mv_verifier"].tolist()
    assert out == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_isotonic_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    rows = [(p, i, 0, float(rng.random())) for p in range(4) for i in range(8)]
    df = frame(spark, rows, ["problem_id", "sample_idx", "y", "v"])
    out = S.calibrate_isotonic(df, ["v"]).orderBy("problem_id", "sample_idx").toPandas()
    for p in range(4):
        x = np.array([r[3] for r in rows if r[0] == p])
        t = np.linspace(0, 1, len(x))
        # brute force: isotonic = projection onto monotone sequences, by a plain QP-free PAV
        order = np.argsort(x)
        yy = list(t[order])
        blocks = [[v] for v in yy]
        changed = True
        while changed:
            changed = False
            for i in range(len(blocks) - 1):
                if np.mean(blocks[i]) > np.mean(blocks[i + 1]):
                    blocks[i] = blocks[i] + blocks.pop(i + 1)
                    changed = True
                    break
        fit = np.concatenate([[np.mean(b)] * len(b) for b in blocks])
        want = np.interp(x, x[order], fit)
        assert out[out.problem_id == p]["v"].to_numpy() == pytest.approx(want)
