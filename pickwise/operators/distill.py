"""Distillation data and scorer (ops 153-156)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import hash_unit, sum_cols
from pickwise.functions.joins import written
from pickwise.sources.tables import explode_samples, union_sources, verifier_columns


def pseudo_labels(df: DataFrame, cols=None, out: str = "label") -> DataFrame:
    """Label of a sample = mean of the chosen score columns (default: every ``_scores`` /
    ``_verdicts`` column); any missing score makes the label missing (NumPy mean)."""
    cols = list(cols) if cols else verifier_columns(df)
    return df.withColumn(out, sum_cols(cols) / F.lit(float(len(cols))))


def pair_table(sources, instruction: str = "instruction", samples: str = "samples") -> DataFrame:
    """(source, problem_idx, sample_idx, instruction, response, label) over several list-form
    datasets given as (table, score columns) pairs: explode samples and scores, pseudo-label
    each sample with the mean of its scores, union with problem ids running on. A source's rows are kept: the numbering
    of its problems reads them several times."""
    rows = []
    for t, score_cols in sources:
        ex = explode_samples(t, [samples, *score_cols], keep=("problem_id", instruction))
        rows.append(written(pseudo_labels(ex, score_cols).select("problem_id", "sample_idx", instruction,
                                                                 F.col(samples).alias("response"), "label"), "pairs"))
    u = union_sources(rows)
    return u.select("source", "problem_idx", "sample_idx", instruction, "response", "label")


def distilled_scorer_fit(pairs: DataFrame, num_features: int = 1 << 18, reg: float = 1e-3, seed: int = 42):
    """Regression from (instruction, response) text to the pseudo-label, re-aimed from a
    transformer cross-encoder to hashed word features: Tokenizer -> HashingTF -> IDF ->
    LinearRegression (squared loss), as an MLlib PipelineModel. The pairs are tokenised once: the weights, the
    regression's statistics, its rows and its summary read the kept counts of hashed words."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
    from pyspark.ml.regression import LinearRegression

    text = pairs.withColumn("__text", F.concat_ws(" [SEP] ", F.col("instruction"), F.col("response")))
    words = RegexTokenizer(inputCol="__text", outputCol="__tok", pattern=r"\W+")
    hashed = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)
    counts = hashed.transform(words.transform(text.filter(F.col("label").isNotNull())))
    counts = written(counts.select("label", "__tf"), "hashed-words")
    weights = IDF(inputCol="__tf", outputCol="features").fit(counts)
    line = LinearRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=0.0,
                            maxIter=50, predictionCol="prediction").fit(weights.transform(counts))
    return PipelineModel([words, hashed, weights, line])


def split_pairs(pairs: DataFrame, validation: float = 0.1, seed: int = 42, keys=("source", "problem_idx")) -> tuple[DataFrame, DataFrame]:
    """(train, validation) pairs; all samples of a problem fall on one side, by its md5 uniform."""
    u = hash_unit(seed, *keys)
    return pairs.where(u >= validation), pairs.where(u < validation)


def distilled_scorer_report(predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(n, mse, mae, accuracy, bias) of predictions against labels; rows without a label do not count."""
    d = predicted.where(F.col("label").isNotNull())
    miss = F.col("prediction") - F.col("label")
    same = (F.col("prediction") >= threshold) == (F.col("label") >= threshold)
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(miss * miss).alias("mse"), F.avg(F.abs(miss)).alias("mae"),
                 F.avg(same.cast("double")).alias("accuracy"), F.avg(miss).alias("bias"))


def distilled_scorer_score(model, pairs: DataFrame) -> DataFrame:
    text = pairs.withColumn("__text", F.concat_ws(" [SEP] ", F.col("instruction"), F.col("response")))
    return model.transform(text).drop("__text", "__tok", "__tf", "features")


def best_epoch(history: DataFrame, patience: int = 3, min_delta: float = 0.0, run: str = "run_id") -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch, epochs_seen) per training run: the loss must drop
    below best - min_delta to count as an improvement; training stops once ``patience`` epochs
    in a row did not improve.  A fold over each run's sorted (epoch, loss) pairs, bounded by its epoch count."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(float("inf")).alias("best"), none.alias("at"), F.lit(0).alias("streak"), none.alias("stop"), F.lit(0).cast("long").alias("seen"))

    def step(s, e):
        better = e["loss"] < s["best"] - F.lit(float(min_delta))
        streak = F.when(better, 0).otherwise(s["streak"] + 1)
        moved = F.struct(F.when(better, e["loss"]).otherwise(s["best"]).alias("best"), F.when(better, e["epoch"]).otherwise(s["at"]).alias("at"),
                         streak.alias("streak"), F.when(streak >= patience, e["epoch"]).alias("stop"), (s["seen"] + 1).alias("seen"))
        return F.when(s["stop"].isNull(), moved).otherwise(s)

    pairs = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("loss").cast("double").alias("loss"))))
    folded = history.groupBy(run).agg(F.aggregate(pairs, start, step).alias("s"))
    return folded.select(run, F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best_loss"), F.col("s.stop").alias("stop_epoch"), F.col("s.seen").alias("epochs_seen"))
