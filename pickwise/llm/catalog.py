"""Queries opN_<name> and ``pipeline``: whole tables, production parameters; DuckDB SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.llm import bpe, decontam, html, langid, lines, oracles, passages, prefixtrie, quality, repair, setjoin, suffixes, urls, warc
from pickwise.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text by the 50k byte-level ranks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op2_line_dedup", lines.oracle_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sources."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


@query("op3_quality_rules", oracles.quality_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule and adaptive thresholds per language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, keep=["doc_id"])


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that repeat across documents."""
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_warc", oracles.warc_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, normalise the archives, read them back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_url_filter", oracles.url_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for the URL of every page."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"]).drop("n_strict", "n_soft")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models learned from three quarters of the labelled documents; prediction for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~F.coalesce(held, F.lit(False))))
    out = langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op8_ngram_jaccard", oracles.jaccard_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by the similarity of their 5-word shingles."""
    return setjoin.linked_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that state benchmark items, with the items."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_structure_repair", oracles.repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage every conversation by the contract's rule, then the cheapest repair of each."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


@query("op12_prefix_trie", oracles.trie_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its members, leaves and savings."""
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op13_suffix_dedup", oracles.suffix_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes that repeated 400-byte strings cover."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)
