"""Rows of very many keys in a batch: every row meets its key's record, the results leave as few batches."""

import pyarrow as pa
from pyspark.sql import functions as F


def test_rows_of_many_keys_meet_their_records_and_leave_in_few_batches(spark):
    from pickwise.functions.keyed import with_record

    def times(key, record, rows):
        return pa.table({"key": rows["key"], "at": rows["at"], "x": pa.array([record * v for v in rows["at"].to_pylist()], pa.int64())})

    rows = spark.range(6_000).repartition(1).select(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(700))).alias("key"), F.col("id").alias("at"))
    rows = rows.withColumn("key", F.when(F.col("at") % 50 > 0, F.col("key")))
    records = spark.range(650).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("w"))
    want = {(r["key"], r["at"], int(r["key"][1:]) * r["at"]) for r in rows.where("key is not null").collect() if int(r["key"][1:]) < 650}

    def result(**sizes):
        return with_record(rows, records, "key", F.lit(1), lambda r: r["w"], times, "key string, at long, x long", "at", **sizes)

    assert len(want) > 5_000
    for sizes in ({}, {"slice_rows": 3}, {"sent_bytes": 0}):
        got = [tuple(r) for r in result(**sizes).collect()]
        assert set(got) == want and len(got) == len(want)

    def count(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(1 for _ in batches)], pa.int64())})

    assert result().mapInArrow(count, "n long").agg(F.sum("n")).first()[0] <= 4
