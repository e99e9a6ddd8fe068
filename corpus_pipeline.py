"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, with the stage's decisions applied to the whole of its input:

1. language ID     documents without a letter or beyond the calibrated bound go; ``lang`` stays as it is;
2. line dedup      lines that stand on many sources are cut out, ``n_chars`` follows the text;
3. near duplicates of each component of similar documents the smallest doc_id stays;
4. decontamination documents that state a benchmark item go;
5. BPE             each remaining text's token count and digests.
"""

from __future__ import annotations

import os
import sys
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pickwise.llm import bpe, decontam, langid, lines, setjoin  # noqa: E402
from pickwise.llm.common import prepare, small_join, stored, table  # noqa: E402
from pickwise.session import ensure_checkpoint_dir  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled three quarters, predict all; rejected documents go."""
    prepare(spark)
    learned = docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))).select("text", "lang")
    model = langid.fit(learned)
    columns = docs.columns
    return langid.predict(docs, model).where(~F.col("rejected")).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines are removed from the texts; a document keeps its row."""
    prepare(spark)
    columns = docs.columns
    cleaned = lines.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id, once if its row repeats.

    Documents without an id are never the ones that go."""
    prepare(spark)
    columns = docs.columns
    linked = stored(setjoin.linked_components(docs.select("doc_id", "text")), "linked")
    gone = stored(linked.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-duplicates")
    kept = small_join(docs, gone, ["doc_id"], "left_anti", most=500_000).select(*columns)
    repeated = stored(linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = small_join(kept, repeated, ["doc_id"], "left_semi", most=500_000).dropDuplicates(["doc_id", "text"])
    return small_join(kept, repeated, ["doc_id"], "left_anti", most=500_000).select(*columns).unionByName(once.select(*columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that state an item of ``benchmark`` go; those without an id count as one document."""
    prepare(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")).alias("__id")
    leaks = stored(decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(key).distinct(), "leaks")
    return small_join(docs.select("*", key), leaks, ["__id"], "left_anti", most=500_000).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each remaining text."""
    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Character models, set similarity components and BPE ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages the rows lie as Parquet in the shared checkpoint folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
