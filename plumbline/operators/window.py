"""Window forms, with NULLs last and BIGINT ranks.

A window without PARTITION BY puts all rows into one task; whole_table() and global_ranks() give the same answers without.
"""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.functions.sem import last_nulls


def over(partition: list[str] | None = None, order: list[str] | None = None) -> WindowSpec:
    spec = Window.partitionBy(*(partition or []))
    return spec.orderBy(*last_nulls(*order)) if order else spec


def whole(agg: Column, partition: list[str] | None = None) -> Column:
    """An aggregate over the whole partition, at every row."""
    return agg.over(over(partition))


def running(agg: Column, partition: list[str], order: list[str]) -> Column:
    """An aggregate from the partition's first row to this one (ROWS)."""
    return agg.over(over(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def rank(partition: list[str] | None = None, order: list[str] | None = None) -> Column:
    """RANK() as BIGINT; without an order every row is first."""
    return F.rank().over(over(partition, order)).cast("long") if order else F.lit(1).cast("long")


def top_n_by(df: DataFrame, partition: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each partition.  Catalyst limits groups before the shuffle (WindowGroupLimit), so a hot partition is cut
    down where it is read."""
    return df.withColumn("__rn", F.row_number().over(over(partition, order))).filter(F.col("__rn") <= n).drop("__rn")


def whole_table(df: DataFrame, **aggs: Column) -> DataFrame:
    """df with aggregates over all of it at every row (``agg OVER ()``): one row of them, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*(a.alias(n) for n, a in aggs.items()))))


def _written_down(df: DataFrame) -> DataFrame:
    """df cut off from what made it, so that every use sees the same partitions."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


def global_ranks(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df with rank, dense_rank, percent_rank and cume_dist over all of it (``OVER (ORDER BY ..)``).

    Distinct keys are counted, dealt by range, and ranked within their range; each range adds what stands in those before
    it.  Only sums by range reach the driver, and no task sees more than a range of distinct keys.
    """
    names = [re.sub("^-", "", o) for o in order]
    keys = df.groupBy(*names).agg(F.count("*").alias("__n"))
    ranges = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _written_down(keys.repartitionByRange(ranges, *last_nulls(*order)).withColumn("__range", F.spark_partition_id()))
    sums = sorted(ranged.groupBy("__range").agg(F.sum("__n").alias("rows"), F.count("*").alias("keys")).collect())
    before = [(r["__range"], sum(x["rows"] for x in sums[:i]), sum(x["keys"] for x in sums[:i])) for i, r in enumerate(sums)]
    total = sum(r["rows"] for r in sums)
    offsets = df.sparkSession.createDataFrame(before, "__range int, __rows long, __keys long")
    spec = over(["__range"], order)
    upto = F.sum("__n").over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__rows")
    ranked = ranged.join(F.broadcast(offsets), "__range").select(
        *(F.col(n).alias(f"__k_{i}") for i, n in enumerate(names)),
        (upto - F.col("__n") + 1).alias("rank"),
        (F.row_number().over(spec) + F.col("__keys")).cast("long").alias("dense_rank"),
        (F.lit(0.0) if total < 2 else (upto - F.col("__n")) / F.lit(float(max(total - 1, 1)))).alias("percent_rank"),
        (upto / F.lit(float(max(total, 1)))).alias("cume_dist"),
    )
    same = reduce(lambda a, b: a & b, (df[n].eqNullSafe(ranked[f"__k_{i}"]) for i, n in enumerate(names)))
    return df.join(ranked, same).drop(*(f"__k_{i}" for i in range(len(names))))
