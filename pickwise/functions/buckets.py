"""Rows laid out once by a key for iterations that join parameters to them and sum by the key again.

The rows are written to the shared checkpoint folder as a bucketed table, so a join on the key and
a sum by it find them where they lie: no step of the iteration moves a row, only the parameters (a row per key) are dealt out.
A key with more than ``part_rows`` rows is cut into parts that lie in different buckets; its parameters are copied to
each, and its partial sums are added afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.joins import join_back, written
from pickwise.session import ensure_checkpoint_dir

PART_ROWS = 1 << 20


class Bucketed:
    """Rows of ``df`` (without null keys) by ``key``; leave the ``with`` block to drop the table's name."""

    def __init__(self, df: DataFrame, key: str, part_rows: int | None = None):
        self.key, spark = key, df.sparkSession
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / (part_rows or PART_ROWS)).cast("int").alias("__parts"))
        sizes = written(sizes, "bucket-parts")
        # the part follows from the row's own values, so a retried task deals it out alike; equal rows share a part
        spread = F.pmod(F.xxhash64(*df.columns), F.col("__parts")).cast("int")
        rows = join_back(df, sizes, key).withColumn("__part", spread).drop("__parts")
        self.name = f"pickwise_rows_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.name}"
        (rows.repartition(buckets, key, "__part").write.bucketBy(buckets, key, "__part").option("path", path).saveAsTable(self.name))
        self.spark, self.rows = spark, spark.table(self.name)
        self.parts = sizes.select(key, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *exc) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def beside(self, params: DataFrame) -> DataFrame:
        """The rows with their key's row of ``params``; the rows stay where they lie."""
        return self.rows.join(params.join(self.parts, self.key), [self.key, "__part"])

    def sums(self, joined: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """(key, sums): summed by key and part in place, the parts' sums by key."""
        near = joined.groupBy(self.key, "__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        return near.groupBy(self.key).agg(*[F.sum(n).alias(n) for n in sums])
