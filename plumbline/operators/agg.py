"""Grouping sets with the grand total over empty input, and skew-proof distinct counts."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_sets(*keys: str) -> list[tuple[str, ...]]:
    return [keys[:n] for n in range(len(keys), -1, -1)]


def cube_sets(*keys: str) -> list[tuple[str, ...]]:
    return [c for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def crossed(*elements: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Several grouping elements side by side: the cross product of their sets, repeats kept."""
    return [tuple(dict.fromkeys(k for part in p for k in part)) for p in product(*elements)]


def _numbered(df: DataFrame, keys: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """Every row once for each set, keys outside of the set NULL: one pass and one shuffle for all sets."""
    choices = F.array(*(F.struct(F.lit(i).alias("__set"), *(F.when(F.lit(k in s), F.col(k)).alias(f"__k_{k}") for k in keys)) for i, s in enumerate(sets)))
    return df.withColumn("__g", F.explode(choices))


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], aggs: list[Column], grouping: str | None = None) -> DataFrame:
    """Aggregates for each set; keys outside of a set are NULL.

    Repeated sets give repeated rows.  An empty set gives its one row also over empty input.  grouping names a BIGINT
    column with the bit mask of the keys that are not in the row's set, the first key as the highest bit.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    proper = [s for s in sets if s]
    mask = lambda s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
    parts = []
    if proper:
        wide = _numbered(df, keys, proper)
        made = wide.groupBy("__g").agg(*aggs)
        masks = F.array(*(F.lit(mask(s)).cast("long") for s in proper))
        extra = [F.element_at(masks, F.col("__g.__set") + 1).alias(grouping)] if grouping else []
        parts.append(made.select(*(F.col(f"__g.__k_{k}").alias(k) for k in keys), *extra, *(c for c in made.columns if c != "__g")))
    for _ in range(len(sets) - len(proper)):
        total = df.agg(*aggs)
        extra = [F.lit(mask(())).cast("long").alias(grouping)] if grouping else []
        parts.append(total.select(*(F.lit(None).cast(dict(df.dtypes)[k]).alias(k) for k in keys), *extra, *total.columns))
    return reduce(DataFrame.unionByName, parts)


def rollup(df: DataFrame, keys: list[str], aggs: list[Column], grouping: str | None = None) -> DataFrame:
    return grouping_sets(df, rollup_sets(*keys), aggs, grouping)


def cube(df: DataFrame, keys: list[str], aggs: list[Column], grouping: str | None = None) -> DataFrame:
    return grouping_sets(df, cube_sets(*keys), aggs, grouping)


def count_distinct_two_level(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """COUNT(DISTINCT value) by keys in two aggregations: rows of a hot key meet by (key, value) first, so no task sees all of them."""
    distinct = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    counted = distinct.groupBy(*keys).agg(F.count("*").alias(name))
    groups = df.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, (groups[k].eqNullSafe(counted[k]) for k in keys))
    return groups.join(counted, same, "left").select(*(groups[k] for k in keys), F.coalesce(counted[name], F.lit(0)).alias(name))


def aggregate_below_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, partial: list[Column], groups: list[str], final: list[Column]) -> DataFrame:
    """An aggregate over a join, first aggregated by the join key: the join then sees one row for each key."""
    return fact.groupBy(fact_key).agg(*partial).join(dim, F.col(fact_key) == dim[dim_key]).groupBy(*groups).agg(*final)
