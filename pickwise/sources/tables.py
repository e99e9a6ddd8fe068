"""Sources, sinks and table hygiene (ops 1-21).

List form (one row per problem, ``samples`` / ``*_scores`` / ``*_verdicts``
arrays) is the reference's storage format; every operator works on the row
form (one row per (problem, sample)) and ``explode_samples`` /
``collect_samples`` convert between the two without a shuffle on the explode
side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.functions.ranks import global_rank

SCORE_SUFFIX = "_scores"
VERDICT_SUFFIX = "_verdicts"
SAMPLE_ALIGNED = ("samples", "extracted_answers", "answer_correct")


# ---------------------------------------------------------------- 1, 2

def verifier_columns(df: DataFrame) -> list[str]:
    """Columns whose name ends with ``_scores`` (reward models) or ``_verdicts`` (judges)."""
    return [c for c in df.columns if c.endswith(SCORE_SUFFIX) or c.endswith(VERDICT_SUFFIX)]


def _read_first(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``: its own Parquet files, else those of its ``data`` split, else all below it.

    Only errors that say that there is nothing to read lead on to the next place."""
    tried = []
    for place, deep in ((path, False), (f"{path.rstrip('/')}/data", False), (f"{path.rstrip('/')}/data-*.parquet", False), (path, True)):
        try:
            return spark.read.option("recursiveFileLookup", str(deep).lower()).parquet(place)
        except AnalysisException as exc:
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            tried.append(f"{place} ({exc.getCondition()})")
    raise FileNotFoundError("no Parquet files at " + ", ".join(tried))


def load_responses(spark: SparkSession, source, verifiers="auto", columns=None) -> DataFrame:
    """Read a list-form problem table from parquet path(s) (or take a DataFrame) and keep the
    identifying columns, the sample-aligned lists and the chosen verifier columns
    (``auto``: found by suffix).  ``problem`` is accepted as ``instruction``.
    Only the kept columns are read from parquet (pruned scan).  A path may name a table, a folder with a
    ``data`` split, or a folder of such folders (:func:`_read_first`)."""
    if isinstance(source, DataFrame):
        df = source
    else:
        paths = [source] if isinstance(source, str) else list(source)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_read_first(spark, p) for p in paths])
    if "instruction" not in df.columns and "problem" in df.columns:
        df = df.withColumnRenamed("problem", "instruction")
    vs = verifier_columns(df) if verifiers == "auto" else list(verifiers)
    keep = [c for c in (columns or ["problem_id", "instruction", "answer", *SAMPLE_ALIGNED]) if c in df.columns]
    return df.select(*keep, *[c for c in vs if c not in keep])


def union_sources(dfs, key: str = "problem_id", source_col: str = "source") -> DataFrame:
    """Concatenate sources by column name; ``problem_idx`` runs on across sources: the
    position of the problem inside its source plus the problem counts of the sources
    before it (a prefix sum over a handful of numbers)."""
    out, offset = [], 0
    for i, df in enumerate(dfs):
        probs = df.select(key).distinct()
        ranked = global_rank(probs, [key], "__pos")
        n = probs.count()
        tagged = (df.join(ranked, key)
                  .withColumn("problem_idx", (F.col("__pos") + F.lit(offset)).cast("bigint"))
                  .withColumn(source_col, F.lit(i)).drop("__pos"))
        out.append(tagged)
        offset += n
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


# ---------------------------------------------------------------- 3, 4, 7

def squeeze_verdicts(c) -> F.Column:
    """[[1.0], [0.0]] -> [1.0, 0.0] (first element of each inner list, NULL if empty)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: F.try_element_at(x, F.lit(1)))


def explode_samples(df: DataFrame, list_cols, keep=("problem_id",)) -> DataFrame:
    """List columns -> one row per (problem, sample) with ``sample_idx`` from 0, in list order.

    ``*_verdicts`` (list of lists) are squeezed first.  Lists of unequal length are
    zipped to the longest (missing entries NULL, see ``check_lengths``)."""
    cols = []
    for c in list_cols:
        col = squeeze_verdicts(c) if c.endswith(VERDICT_SUFFIX) else F.col(c)
        cols.append(col.alias(c))
    z = F.arrays_zip(*cols)
    ex = df.select(*keep, F.posexplode(z).alias("sample_idx", "__z"))
    return ex.select(*keep, F.col("sample_idx").cast("int").alias("sample_idx"),
                     *[F.col(f"__z.{c}").alias(c) for c in list_cols])


def collect_samples(df: DataFrame, cols, key: str = "problem_id") -> DataFrame:
    """Inverse of :func:`explode_samples`: one row per problem, lists ordered by sample_idx.

    The list form is bounded by the samples of one problem (the reference keeps
    up to 1,000); a problem is materialised as one row, so use it only to write
    that format, never inside a pipeline."""
    st = F.array_sort(F.collect_list(F.struct(F.col("sample_idx").alias("__i"), *[F.col(c) for c in cols])))
    g = df.groupBy(key).agg(st.alias("__l"))
    def field(c):
        return lambda s: s[c]

    return g.select(key, *[F.transform("__l", field(c)).alias(c) for c in cols])


# ---------------------------------------------------------------- 5, 6

def melt_scores(df: DataFrame, verifiers, ids=("problem_id", "sample_idx")) -> DataFrame:
    """Wide -> long (ids..., verifier, score); no shuffle."""
    return df.unpivot(list(ids), list(verifiers), "verifier", "score")


def pivot_scores(long: DataFrame, verifiers, ids=("problem_id", "sample_idx")) -> DataFrame:
    """Long -> wide with an explicit verifier list (no extra pass to find the values)."""
    return long.groupBy(*ids).pivot("verifier", list(verifiers)).agg(F.first("score"))


# ---------------------------------------------------------------- 8, 21

def write_dataset(df: DataFrame, path: str, partition_by=None) -> DataFrame:
    """Write parquet with overwrite; the output committer writes to a temporary folder and
    moves it into place, so a failed job never leaves a half-written dataset."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def save_params(params: DataFrame, path: str, model: str, verifiers) -> None:
    """Persist a fitted parameter table plus a readable (verifier, position) table."""
    spark = params.sparkSession
    params.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(f"{path}/params")
    spark.createDataFrame([(v, i) for i, v in enumerate(verifiers)], "verifier string, position int") \
        .write.mode("overwrite").parquet(f"{path}/verifiers")


def load_params(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    vs = [r["verifier"] for r in spark.read.parquet(f"{path}/verifiers").orderBy("position").collect()]
    return spark.read.parquet(f"{path}/params").drop("model"), vs


# ---------------------------------------------------------------- 9

def rename_verifiers(long: DataFrame, registry: DataFrame, on_dup: str = "error") -> DataFrame:
    """Raw -> display name over a long score table; unknown names stay.  Two raw names that
    map to one display name: ``error`` raises, ``first`` keeps the first raw name in
    ``position`` order.  ``registry``: (raw_name, name); tens of rows, broadcast."""
    reg = F.broadcast(registry.select("raw_name", "name"))
    named = (long.join(reg, long["verifier"] == reg["raw_name"], "left")
             .withColumn("display", F.coalesce(F.col("name"), F.col("verifier"))))
    raws = named.select("verifier", "display", "position").distinct()
    dups = raws.groupBy("display").agg(F.count(F.lit(1)).alias("n"),
                                      F.min_by("verifier", "position").alias("first_raw"))
    if on_dup == "error":
        bad = dups.filter(F.col("n") > 1).collect()
        if bad:
            raise ValueError(f"duplicate verifier names after renaming: {[r['display'] for r in bad]}")
    keep = F.broadcast(dups.select(F.col("first_raw").alias("verifier")))  # one row per verifier
    return (named.join(keep, "verifier", "left_semi")
            .drop("raw_name", "name", "verifier").withColumnRenamed("display", "verifier"))


# ---------------------------------------------------------------- 10-13

REQUIRED = {"choice": ["instruction", "samples", "answer", "options"],
            "math": ["instruction", "samples", "answer"]}


def check_input(df: DataFrame, kind: str = "math") -> DataFrame:
    """Raise on a missing required column; return (problem_id, reasons) for bad problems:
    null or empty samples, null answer, empty options."""
    if "instruction" not in df.columns and "problem" in df.columns:
        df = df.withColumnRenamed("problem", "instruction")
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    checks = [F.when(F.col("samples").isNull() | (F.size("samples") == 0), F.lit("no_samples")),
              F.when(F.col("answer").isNull(), F.lit("no_answer"))]
    if kind == "choice":
        checks.append(F.when(F.col("options").isNull() | (F.size("options") == 0), F.lit("no_options")))
    reasons = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select("problem_id", reasons.alias("reasons")).filter(F.size("reasons") > 0) \
        .select("problem_id", F.array_join("reasons", ",").alias("reasons"))


def problem_positions(df: DataFrame, key: str = "problem_id") -> DataFrame:
    """(key, position): 0-based position of each problem in key order (distributed rank)."""
    return global_rank(df.select(key).distinct(), [key], "position")


def row_range(df: DataFrame, start: int = 0, end: int | None = None, max_rows: int | None = None,
              key: str = "problem_id") -> DataFrame:
    """Problems at positions [start, end), then the first ``max_rows`` of those."""
    pos = problem_positions(df, key)
    hi = end if end is not None else None
    if max_rows is not None:
        hi = start + max_rows if hi is None else min(hi, start + max_rows)
    cond = F.col("position") >= start
    if hi is not None:
        cond = cond & (F.col("position") < hi)
    return df.join(pos.filter(cond), key).drop("position")


def limit_samples(df: DataFrame, k: int, list_cols=None) -> DataFrame:
    """First k samples: row form ``sample_idx < k``; list form slices every sample-aligned list."""
    if list_cols is None:
        return df.filter(F.col("sample_idx") < k)
    return df.select(*[F.slice(c, 1, k).alias(c) if c in list_cols else F.col(c) for c in df.columns])


def sample_aligned_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in SAMPLE_ALIGNED or SCORE_SUFFIX in c or c.endswith(VERDICT_SUFFIX)
            or c.endswith("_correct")]


def check_lengths(df: DataFrame, verifiers) -> DataFrame:
    """(problem_id, verifier, n_samples, n_scores) where a score list length differs from the samples."""
    rows = [df.select("problem_id", F.lit(v).alias("verifier"), F.size("samples").alias("n_samples"),
                      F.size(v).alias("n_scores")) for v in verifiers]
    return reduce(DataFrame.unionByName, rows).filter(F.col("n_samples") != F.col("n_scores"))


# ---------------------------------------------------------------- 15-17

def filter_type(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def dev_set(lines: DataFrame, scores: DataFrame, n_samples: int, labels: DataFrame | None = None) -> DataFrame:
    """Parse dev-set lines (``value``: "problem sample" or one flat index problem*R + sample),
    drop indices that match no row, attach external labels (``labels``: line_no, dev_label)
    or the rows' own ``y``.  Returns (problem_id, sample_idx, dev_label)."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    parsed = (lines.filter(F.trim(F.col("value")) != "")
              .select("line_no", parts.alias("p"))
              .select("line_no",
                      F.when(F.size("p") == 2, F.col("p")[0].try_cast("bigint"))
                       .otherwise((F.col("p")[0].try_cast("bigint") / F.lit(n_samples)).cast("bigint")).alias("problem_id"),
                      F.when(F.size("p") == 2, F.col("p")[1].try_cast("int"))
                       .otherwise(F.pmod(F.col("p")[0].try_cast("bigint"), F.lit(n_samples)).cast("int")).alias("sample_idx")))
    j = parsed.join(scores.select("problem_id", "sample_idx", "y"), ["problem_id", "sample_idx"])
    if labels is not None:
        j = j.join(labels, "line_no", "left").withColumn("dev_label", F.coalesce("dev_label", "y"))
    else:
        j = j.withColumn("dev_label", F.col("y"))
    return j.select("problem_id", "sample_idx", F.col("dev_label").cast("int").alias("dev_label"))


def subset_fraction(df: DataFrame, fraction: float) -> DataFrame:
    """No dev set: the first int(n * fraction) rows in (problem_id, sample_idx) order; all at 1."""
    if fraction >= 1:
        return df
    n = df.count()
    m = int(n * fraction)
    ranked = global_rank(df, ["problem_id", "sample_idx"], "__rank")
    return ranked.filter(F.col("__rank") < m).drop("__rank")


# ---------------------------------------------------------------- 18-20

def export_scores(scored: DataFrame, prob: str = "p1") -> DataFrame:
    """(problem_id, sample_idx, prob, bucket): 'positive' when prob > 0.5, else 'negative'."""
    return scored.select("problem_id", "sample_idx", F.col(prob).alias("prob"),
                         F.when(F.col(prob) > 0.5, "positive").otherwise("negative").alias("bucket"))


def export_null_scores(dfs) -> DataFrame:
    """One NULL prediction per (task, sample) over all sources, task ids offset per source."""
    u = union_sources([d.select("problem_id", "sample_idx") for d in dfs])
    return u.select(F.col("problem_idx").alias("task_id"), "sample_idx",
                    F.lit(None).cast("double").alias("prob"), F.lit("null").alias("bucket"))


def attach_scores(problems: DataFrame, scores: DataFrame, out: str = "selection_scores") -> DataFrame:
    """Put per-problem score lists back on the list-form table; problems without scores get a
    list of 0.0 of their own sample count.  ``scores``: (problem_id, scores ARRAY<DOUBLE>)."""
    j = problems.join(scores.withColumnRenamed("scores", "__s"), "problem_id", "left")
    fill = F.array_repeat(F.lit(0.0), F.size("samples"))
    return j.withColumn(out, F.coalesce(F.col("__s"), fill)).drop("__s")
