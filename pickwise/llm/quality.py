"""Operator 3: quality rules with thresholds learned per language and source.

Base counts are taken per text in Arrow batches. On top of the fixed base rule, a text is
dropped when one of its ratios lies far outside its own group (language, source):
above Q3 + ``spread`` * max(Q3 - Q1, floor of that ratio). The quartiles come from
mergeable quantile sketches: each value falls into a logarithmic bucket with relative
width ``accuracy``, a sketch is the bucket counts, and merging is addition. So the sketch
of a group holding a third of all rows is pre-aggregated in every task, does not depend on
the order of merging, and is a few hundred numbers whatever the input; the thresholds
(one row per group) are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pickwise.llm.common import SPACES, prepare, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Ratio -> the least spread (Q3 - Q1) that counts, so that uniform groups keep ordinary texts.
RATIOS = {"symbol_ratio": 0.02, "dup_line_ratio": 0.1, "chars_per_word": 1.0}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found at least twice in the text.

    Windows are numbered exactly, by doubling (pairs, fours, fives): no hash decides."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) == n:
        return 0

    def number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (int(b.max()) + 1) + b
        return np.unique(key, return_inverse=True)[1]

    two = number(w[:-1], w[1:])
    if int(two.max()) == len(two) - 1:
        return 0
    four = number(two[:-2], two[2:])
    five = number(four[:-1], w[4:])
    twice = np.bincount(five)[five] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: zeros)."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words))


def with_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the base counts, the number of worded lines and base_failed to the columns ``keep`` (all)."""
    prepare(df.sparkSession)
    new = [*BASE, "n_lines", "base_failed"]
    keep = [c for c in (keep or df.columns) if c not in new]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = rows.drop("__text").schema
    for name in new[:-1]:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(len(keep)):
                text = v.as_py()
                n, *rest, rep = base_counts(text)
                lines = sum(bool(x.strip(SPACES)) for x in text.split("\n")) if text else 0
                out.append((n, *rest, rep, lines, n < 10 or 100 * rep > 20 * n))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[*keep, *new])

    return rows.mapInArrow(run, schema)


def ratio_columns() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbol_ratio": F.col("n_symbols") / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "chars_per_word": F.col("word_chars") / words}


def bucket_of(value: Column, accuracy: float = 0.01) -> Column:
    """Logarithmic bucket of a value >= 0; values under 0.001 share bucket -1."""
    return F.when(value < 1e-3, F.lit(-1)).otherwise(F.floor(F.log(value / 1e-3) / F.log(F.lit(1 + accuracy))).cast("int"))


def bucket_value(bucket: Column, accuracy: float = 0.01) -> Column:
    return F.when(bucket < 0, F.lit(0.0)).otherwise(F.lit(1e-3) * F.pow(F.lit(1 + accuracy), bucket + F.lit(0.5)))


def group_quartiles(counted: DataFrame, groups: list[str], accuracy: float = 0.01) -> DataFrame:
    """(groups, ratio, q1, q3) from bucket counts of the rows that pass the base rule."""
    ratios = ratio_columns()
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket_of(v, accuracy).alias("bucket")) for k, v in ratios.items()]))
    sketch = (counted.where(~F.col("base_failed")).select(*groups, values.alias("v")).select(*groups, "v.ratio", "v.bucket")
              .groupBy(*groups, "ratio", "bucket").agg(F.count(F.lit(1)).alias("n")))
    below = Window.partitionBy(*groups, "ratio").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups, "ratio")
    ranked = sketch.withColumn("upto", F.sum("n").over(below)).withColumn("total", F.sum("n").over(whole))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bucket")))

    got = ranked.groupBy(*groups, "ratio").agg(at(0.25).alias("b1"), at(0.75).alias("b3"))
    return got.select(*groups, "ratio", bucket_value(F.col("b1"), accuracy).alias("q1"), bucket_value(F.col("b3"), accuracy).alias("q3"))


def judge(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          spread: float = 6.0, keep: list[str] | None = None) -> DataFrame:
    """Base counts, base_failed, kept and the first ratio that failed (``failed_ratio``, else null).

    Null languages and sources form groups of their own. Null text counts as empty and so
    fails the base rule. A group all of whose rows fail it has no thresholds and needs
    none. Repeated rows count each; extra columns stay unless ``keep`` names the wanted."""
    columns = [c for c in (keep or df.columns)]
    rows = df.select(*[F.col(f"`{c}`") for c in columns],
                     F.coalesce(F.col(lang_col).cast("string"), F.lit("\x00")).alias("__lang"),
                     F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")).alias("__source"),
                     F.col(text_col).cast("string").alias("__body"))
    counted = stored(with_counts(rows, "__body", [*columns, "__lang", "__source"]), "quality")
    limits = group_quartiles(counted, ["__lang", "__source"])
    cut = F.col("q3") + F.lit(spread) * F.greatest(
        F.col("q3") - F.col("q1"), F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v))])[F.col("ratio")])
    wide = limits.groupBy("__lang", "__source").agg(
        *[F.max(F.when(F.col("ratio") == k, cut)).alias(f"__cut_{k}") for k in RATIOS])
    fails = F.coalesce(*[F.when(v > F.col(f"__cut_{k}"), F.lit(k)) for k, v in ratio_columns().items()])
    joined = counted.join(_bounded(wide), ["__lang", "__source"], "left")
    kept = [c for c in columns if c not in (*BASE, "n_lines", "base_failed", "kept", "failed_ratio")]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *BASE, "base_failed",
                         (~F.col("base_failed") & fails.isNull()).alias("kept"),
                         F.when(~F.col("base_failed"), fails).alias("failed_ratio"))


def _bounded(limits: DataFrame, most: int = 200_000) -> DataFrame:
    """Broadcast the thresholds where they are counted to be few; else leave the join to Spark."""
    limits = stored(limits, "thresholds")
    return F.broadcast(limits) if limits.limit(most + 1).count() <= most else limits
