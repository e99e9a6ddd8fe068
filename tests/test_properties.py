"""Property tests on small random tables."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pickwise.operators import metrics as M
from pickwise.operators import scores as S

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

values = st.one_of(st.none(), st.floats(min_value=-50, max_value=50, allow_nan=False), st.sampled_from([-1.0, 0.0, 1.0]))


def table(spark, cols):
    rows = [(i // 4, i % 4, i % 2, *vals) for i, vals in enumerate(zip(*cols))]
    schema = "problem_id bigint, sample_idx int, y int, " + ", ".join(f"v{j} double" for j in range(len(cols)))
    return spark.createDataFrame(rows, schema)


@SETTINGS
@given(st.lists(values, min_size=4, max_size=16), st.lists(values, min_size=4, max_size=16))
def test_minmax_lands_in_unit_interval_or_is_untouched(spark, a, b):
    n = min(len(a), len(b))
    df = table(spark, [a[:n], b[:n]])
    out = S.minmax_all(df, ["v0", "v1"]).collect()
    for col, src in (("v0", a[:n]), ("v1", b[:n])):
        present = [x for x in src if x is not None]
        gated = (not present or all(x in (-1.0, 0.0, 1.0) for x in present)
                 or (min(present) >= 0 and max(present) <= 1))
        for r, x in zip(sorted(out, key=lambda r: (r.problem_id, r.sample_idx)), src):
            v = r[col]
            if gated:
                assert v == x or (v is None and x is None)
            elif v is not None:
                assert -1e-12 <= v <= 1 + 1e-12


@SETTINGS
@given(st.lists(st.sampled_from([-1.0, 0.0, 0.3, 0.7, 1.0]), min_size=4, max_size=12))
def test_binarize_keeps_abstain_and_negation_is_an_involution(spark, a):
    df = table(spark, [a])
    b = [r.v0 for r in S.binarize_fixed(df, ["v0"], 0.5).orderBy("problem_id", "sample_idx").collect()]
    assert [x == -1.0 for x in b] == [x == -1.0 for x in a]
    n1 = S.negate_verifier(df, ["v0"]).select("problem_id", "sample_idx", F.col("`~v0`").alias("v0"))
    n2 = S.negate_verifier(n1, ["v0"]).orderBy("problem_id", "sample_idx").collect()
    assert all(abs(r["~v0"] - x) < 1e-12 for r, x in zip(n2, a))


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=1), min_size=1, max_size=9))
def test_majority_of_a_constant_answer(spark, ys):
    rows = [(1, i, y, "same") for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "problem_id bigint, sample_idx int, y int, answer string")
    got = M.majority_vote(df).first()["majority_correct"]
    assert got == int(sum(ys) > len(ys) / 2)


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=1), min_size=1, max_size=8))
def test_unbiased_pass_at_n_is_coverage(spark, ys):
    rows = [(1, i, y) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "problem_id bigint, sample_idx int, y int")
    n = len(ys)
    got = {r["k"]: r["pass_at_k"] for r in M.pass_at_k_unbiased(df, list(range(1, n + 1))).collect()}
    assert math.isclose(got[n], float(max(ys)))
    assert math.isclose(got[1], sum(ys) / n)
    assert all(got[k] <= got[k + 1] + 1e-12 for k in range(1, n))
