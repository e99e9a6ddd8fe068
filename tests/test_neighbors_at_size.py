"""Neighbours that the tree rules out little of, and dense groups: the same rows from bounded pieces."""

import math

import numpy as np
import pyarrow as pa
import pytest

from pickwise.functions.keyed import with_record
from pickwise.operators import neighbors as NB
from pickwise.operators.groups import cluster_density


def _table(spark, x, first=0, column="vec"):
    return spark.createDataFrame([(first + i, [float(v) for v in p]) for i, p in enumerate(x)], f"problem_id long, {column} array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_tiles_find_the_same_neighbours(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(150, 24)), rng.normal(size=(900, 24))
    y[5] = y[6] = x[0]
    test, train = _table(spark, x), _table(spark, y, 1_000)
    found = []
    for least in (1 << 40, 0):
        monkeypatch.setattr(NB, "WIDE_PAIRS", least)
        monkeypatch.setattr(NB, "BLOCK", 1 << 19 if least else 700)
        found.append({(r["test_id"], r["rank"]): (r["train_id"], r["distance"]) for r in NB.exact_knn(test, train, 4, metric=metric).collect()})
    assert found[0] == found[1] and len(found[0]) == 600 and found[0][0, 1][0] == 1_005 and found[0][0, 2][0] == 1_006


def test_tiles_are_taken_where_the_tree_rules_out_little(spark, monkeypatch):
    monkeypatch.setattr(NB, "WIDE_PAIRS", 0)
    rng = np.random.default_rng(4)
    for x, wide in ((rng.normal(size=(3_000, 48)), True), (rng.random((3_000, 2)), False)):
        rows = _table(spark, x).selectExpr("'' AS node", "problem_id AS train_id", "vec", "true AS lead")
        points = rows.selectExpr("node", "train_id AS test_id", "vec", f"{5.0 if wide else 0.05}D AS bound")
        assert NB.PivotTree(rows, NB.Metric(), leaf=64).wide(points) is wide


def _dbscan(x, eps, least):
    near = [[j for j in range(len(x)) if math.dist(x[i], x[j]) <= eps] for i in range(len(x))]
    core = [len(n) >= least for n in near]
    label, count = [-1] * len(x), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = count
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = count
                        todo.append(j)
            count += 1
    return [c if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i, c in enumerate(label)]


@pytest.mark.parametrize("least", [1 << 40, 0])
def test_density_equals_the_plain_algorithm(spark, monkeypatch, least):
    monkeypatch.setattr(NB, "WIDE_PAIRS", least)
    monkeypatch.setattr(NB, "BLOCK", 500)
    monkeypatch.setattr(NB, "POINTS", 40)
    monkeypatch.setattr(NB, "CHUNK", 30)
    if not least:
        monkeypatch.setattr(NB, "WIDE", 0.0)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.15, (60, 2)) for c in ((0, 0), (1.2, 0), (4, 4))] + [rng.random((60, 2)) * 6]).round(3)
    got = {r["problem_id"]: r["cluster_id"] for r in cluster_density(_table(spark, x, column="embedding"), 0.2, 5).collect()}
    assert [got[i] for i in range(len(x))] == _dbscan(x.tolist(), 0.2, 5)


def test_links_of_a_dense_group_follow_its_rows(spark):
    """600 rows within the radius of each other have 179,700 pairs; the links that connect them are few."""
    rng = np.random.default_rng(6)
    df = _table(spark, rng.random((600, 3)) * 0.1)
    near = NB.Within(df, 1.0)
    assert {r["n"] for r in near.counts().collect()} == {600}
    core = df.selectExpr("problem_id AS node")
    assert 599 <= near.links(core).count() < 20 * 600


def test_a_sent_record_meets_rows_in_slices(spark):
    """A step that makes many rows of one gets few at a time, so that no batch grows with the table."""
    rows = spark.range(0, 5_000, 1, 1).selectExpr("'a' AS k", "id")
    records = spark.createDataFrame([("a", 1.0)], "k string, w double")
    one = lambda name, record, table: pa.table({"n": pa.array([len(table)], pa.int64())})
    from pyspark.sql import functions as F

    got = [r["n"] for r in with_record(rows, records, "k", F.lit(1), dict, one, "n long", "id", slice_rows=300).collect()]
    assert max(got) == 300 and sum(got) == 5_000


def test_no_tree_where_nobody_asks(spark, monkeypatch):
    train = _table(spark, np.random.default_rng(1).random((40, 2)))
    monkeypatch.setattr(NB, "PivotTree", None)
    got = NB.exact_knn(train.limit(0), train, 2)
    assert got.columns == ["test_id", "train_id", "distance", "rank"] and got.count() == 0
