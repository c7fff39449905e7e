"""Labels of documents: which rows may be learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from all learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)).cast("int")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label, fold) of labels that may be learned from: not held out, 0 or 1, one row for each id (its largest)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    return known.withColumn("fold", fold()).filter("fold <> 0").groupBy("doc_id", "fold").agg(F.max("label").alias("label"))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """All rows if they are no more than so many, else those whose hash of the id is below a bound, the same in every run.

    The bound is set for 98 % of so many, which leaves a margin of many standard deviations.  A filter needs no sort and no
    task that sees more than its own rows, as a top-n by hash would.
    """
    n = rows.count()
    if n <= most:
        return rows
    space = 1 << 40
    return rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(97)), F.lit(space)) < int(0.98 * most / n * space))
