"""Streaming: score new responses with a fitted model and keep running selection reports.

The reference is batch-only; what carries over to a stream is everything that
is a projection once the parameters are fixed: normalise with stored bounds,
binarise, naive Bayes / label model / ensemble scoring.  A fitted parameter
table is a static DataFrame inlined as literals when the stream starts.  The
per-problem choice over a stream uses an event-time window with a watermark,
so state for a problem is dropped once its window can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.models.naive_bayes import nb_log_odds, nb_log_tables


def frozen_minmax(stats_row: dict, verifiers):
    """Gated min-max with bounds fixed at fit time (dict from ``gate_stats(...).first()``)."""
    exprs = {}
    for v in verifiers:
        mn, mx = stats_row[f"{v}__min"], stats_row[f"{v}__max"]
        keep = stats_row[f"{v}__n"] == 0 or stats_row[f"{v}__nd"] == 0 or (mn >= 0 and mx <= 1)
        exprs[v] = F.col(v) if keep or mx == mn else (F.col(v) - F.lit(mn)) / F.lit(mx - mn)
    return exprs


def score_stream(stream: DataFrame, stats_row: dict, params: DataFrame, verifiers, threshold: float = 0.5) -> DataFrame:
    """Normalise with frozen bounds, fill, binarise, then naive Bayes p1 (params broadcast)."""
    norm = frozen_minmax(stats_row, verifiers)
    cols = []
    for c in stream.columns:
        if c in norm:
            x = F.coalesce(norm[c], F.lit(0.0))
            cols.append(F.when(x == -1, -1.0).when(x >= F.lit(threshold), 1.0).otherwise(0.0).alias(c))
        else:
            cols.append(F.col(c))
    votes = stream.select(*cols)
    vals = nb_log_tables(params, verifiers).first().asDict()  # fixed at stream start: literals
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-nb_log_odds(verifiers, vals)))
    return votes.withColumn("p1", p1)


def windowed_selection(scored: DataFrame, ts_col: str = "ts", window: str = "1 hour",
                       watermark: str = "10 minutes") -> DataFrame:
    """Per (event-time window, problem): the best sample so far (max p1, lowest sample_idx),
    its label and the number of samples; append mode emits each window once it closes."""
    return (scored.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window), "problem_id")
            .agg(F.max_by(F.struct("sample_idx", "y"), F.struct(F.col("p1"), -F.col("sample_idx"))).alias("t"),
                 F.count(F.lit(1)).alias("n_samples"))
            .select("window", "problem_id", F.col("t.sample_idx").alias("top1_idx"),
                    F.col("t.y").alias("top1_label"), "n_samples"))
