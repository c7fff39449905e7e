"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex
from plumbline.llm import decontaminate, jaccard_join, labelled, line_dedup, mixing, oracles, pii, quality_crf, quote_links, spans, spotsigs, substring_dedup, toxicity_kn


def _held_out_scores(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(ex.read_docs(spark, sf_dir), ex.read_docs(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ex.read_docs(spark, sf_dir).select("doc_id", "text")
    return mixing.mixed(docs, ex.read_docs(spark, sf_dir, "labels")).drop("text")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(ex.read_docs(spark, sf_dir))


def op4_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ex.read_docs(spark, sf_dir).select("doc_id", "text")
    model = toxicity_kn.fit(docs, ex.read_docs(spark, sf_dir, "labels"))
    return _held_out_scores(toxicity_kn.score(docs, model), 0.5)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_components(ex.read_docs(spark, sf_dir), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "n_in_component")


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ex.read_docs(spark, sf_dir).select("doc_id", "text")
    model = quality_crf.fit(docs, ex.read_docs(spark, sf_dir, "labels"))
    return _held_out_scores(quality_crf.score(docs, model), 0.3)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(ex.read_docs(spark, sf_dir))


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quote_links.reply_ordered(ex.read_docs(spark, sf_dir, "conversations"))
    return out.drop("text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(ex.read_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.size("removed_spans"), F.lit(0)).alias("n_removed"), "removed_chars", spans.as_text("removed_spans").alias("removed"), "text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(ex.read_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.size("removed_spans"), F.lit(0)).alias("n_removed"), "removed_chars", spans.as_text("removed_spans").alias("removed"), "text")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_mixing, op3_spotsigs, op4_toxicity_kn, op5_jaccard_join, op6_quality_crf, op7_pii, op8_quote_links, op9_line_dedup, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = oracles.SQL
