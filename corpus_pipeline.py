"""A training-corpus pipeline of the text operators; each stage works on all that its predecessor kept.

A stage is called as stage(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, with n_chars in step with the text.  Null and empty texts pass: no stage has anything against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_crf
from plumbline.llm import exchange as ex

LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model finds bad go."""
    model = quality_crf.fit(docs, ex.read_docs(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model, "__score").filter(F.col("__score") >= LEAST_QUALITY).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document of which nothing is left goes with them."""
    out = line_dedup.dedup(docs).filter("removed_chars = 0 OR trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("removed_chars") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, ex.read_docs(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate; those with a rate of 0 are not in the mix."""
    return mixing.mixed(docs, ex.read_docs(spark, sf_dir, "labels")).filter("rate > 0")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
]
#: Classifiers are trained on the way, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written to the shared folder before the next one reads it."""
    docs = ex.read_docs(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = ex.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
