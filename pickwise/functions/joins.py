"""Joining small per-key tables back to rows when one key may hold a third of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pickwise.session import ensure_checkpoint_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: lineage ends there, and the plan
    that makes it runs once (``checkpoint()`` would run its last stage twice)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_back(rows: DataFrame, per_key: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join per-key statistics to their rows.

    The statistics are materialised first (reliable checkpoint). Both sides of the join are
    then plain exchanges, which Spark's adaptive skew join can split: a hot key's rows are
    dealt to several tasks with a copy of its one statistics row."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return rows.join(per_key.checkpoint(), keys, how)
