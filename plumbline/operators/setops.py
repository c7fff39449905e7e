"""Set operations by position, with types widened as in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def _named(first: DataFrame, *others: DataFrame) -> list[DataFrame]:
    for o in others:
        if len(o.columns) != len(first.columns):
            raise ValueError(f"{len(first.columns)} and {len(o.columns)} columns")
    return [first, *(o.toDF(*first.columns) for o in others)]


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, _named(*frames))


def union(*frames: DataFrame) -> DataFrame:
    """Distinct rows; NULL equals NULL and NaN equals NaN."""
    return union_all(*frames).distinct()


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """Rows of both; with every, each as often as the side with fewer copies has it."""
    a, b = _named(a, b)
    return a.intersectAll(b) if every else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """Rows of a that b lacks; with every, b's copies are taken off a's."""
    a, b = _named(a, b)
    return a.exceptAll(b) if every else a.subtract(b)
