"""Catalog: scoring a stream of responses with a fitted naive Bayes model."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.models.naive_bayes import nb_fit
from pickwise.operators.scores import gate_stats
from pickwise.plans.catalog.models import FLAG, _votes_sql
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.registry import register
from pickwise.plans.selection import weak_votes
from pickwise.session import ensure_checkpoint_dir
from pickwise.sources.fixtures import f1
from pickwise.streaming.scoring import score_stream


def _to_files(spark, rows, root):
    """Run a stream to its end in append mode into Parquet files below ``root``; the files read back."""
    query = (rows.writeStream.format("parquet").option("path", os.path.join(root, "out"))
             .option("checkpointLocation", os.path.join(root, "checkpoint")).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(os.path.join(root, "out"))


@register("stream_naive_bayes", sql=f"WITH {_votes_sql(FLAG)}, prm AS ({Q.nb_params('b', FLAG)}), s AS ({Q.nb_p1('b', 'prm', FLAG)}) "
          "SELECT problem_id, sample_idx, round(p1, 6) AS p1 FROM s")
def stream_naive_bayes(spark, sf):
    """Fit on the batch table, then score the same rows arriving as a file stream (the score
    table written once to the shared checkpoint folder); run to completion with an
    available-now trigger into a file sink and read that back."""
    base = f1(spark, sf).select("problem_id", "sample_idx", "y", *FLAG)
    stats = gate_stats(base, FLAG).first().asDict()
    params = nb_fit(weak_votes(base, FLAG), FLAG)
    root = os.path.join(ensure_checkpoint_dir(spark), "pickwise-stream", uuid.uuid4().hex)
    base.write.mode("overwrite").parquet(os.path.join(root, "source"))
    stream = spark.readStream.schema(base.schema).parquet(os.path.join(root, "source"))
    scored = score_stream(stream, stats, params, FLAG)
    return _to_files(spark, scored, root).select("problem_id", "sample_idx", r6("p1", "p1"))


@register("stream_windowed_selection", fixtures=(), sql="""
SELECT window_start, problem_id, CAST(top1_idx AS INT) AS top1_idx, top1_label, n_samples FROM (
  SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, l_shipdate)) AS BIGINT) AS window_start, l_orderkey AS problem_id, l_linenumber AS top1_idx,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS top1_label,
         count(*) OVER (PARTITION BY time_bucket(INTERVAL 1 DAY, l_shipdate), l_orderkey) AS n_samples,
         row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 DAY, l_shipdate), l_orderkey
                            ORDER BY l_discount DESC, l_linenumber) AS rk
  FROM lineitem) WHERE rk = 1""")
def stream_windowed_selection(spark, sf):
    """Event-time selection over a stream of scored lines (event time = ship date, problem =
    order, sample = line number, score = discount): per (1-day window, problem) the best sample,
    with a watermark; the stream source is the table written once to the checkpoint folder.
    Window starts are reported as epoch seconds (UTC)."""
    from pickwise.sources.fixtures import read_table
    from pickwise.streaming.replay import replay
    from pickwise.streaming.scoring import windowed_selection

    src = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("sample_idx"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_discount").alias("p1"),
        # the naive ship time read as a UTC instant (independent of the session time zone)
        F.date_trunc("second", F.from_utc_timestamp(F.col("l_shipdate").cast("timestamp"), F.current_timezone())).alias("ts"))
    found = src.groupBy(F.floor(F.unix_seconds("ts") / 86_400).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts")).alias("last")).collect()
    # a closing row far ahead moves the watermark past every real window; its own window never closes
    last = max((r["last"] for r in found if r["last"] is not None), default=None)
    closing = spark.range(1, numPartitions=1).select(
        F.lit(None).cast("bigint").alias("problem_id"), F.lit(None).cast("int").alias("sample_idx"), F.lit(0).alias("y"),
        F.lit(None).cast("double").alias("p1"), (F.timestamp_micros(F.lit(last).cast("bigint")) + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    days = {r["day"]: r["n"] for r in found if r["day"] is not None}
    return replay(src.unionByName(closing), lambda stream: windowed_selection(stream, "ts", "1 day", "1 day"), days).select(
        F.unix_seconds(F.col("window.start")).alias("window_start"), "problem_id", F.col("top1_idx").cast("int").alias("top1_idx"), "top1_label", "n_samples")
