"""Global 0-based ranks without an unpartitioned window.

``orderBy`` range-partitions the rows over many tasks; ``monotonically_increasing_id``
numbers each task's rows in order (partition in the high bits, row in the low 33).
The numbered rows are written out, so a lost executor cannot renumber them; the
per-partition row counts (one small number per partition) become offsets on the
driver and return as a map literal.  All of it stays in the JVM.  The order columns
must be unique so that ranks are reproducible.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.joins import written


def global_rank(df: DataFrame, order_cols, rank_col: str = "rank") -> DataFrame:
    """Add ``rank_col`` (BIGINT, 0-based) = position of the row in ``order_cols`` order."""
    spark = df.sparkSession
    numbered = written(df.orderBy(*order_cols).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    counts = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame([(p, off) for (p, _), off in zip(counts, before)], "__part long, __off long")
    return (numbered.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row per partition
            .withColumn(rank_col, F.col("__off") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__part", "__off", "__id"))
