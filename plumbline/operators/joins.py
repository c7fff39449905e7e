"""Joins by name.  All are declarations: Catalyst picks broadcast, hash or sort-merge, and adaptive execution splits skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast by hand; Spark's own threshold decides everywhere else.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows it, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def on_keys(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], null_equal: bool = False) -> Column:
    """left.a = right.b for each pair, NULL equal to NULL if wanted."""
    terms = [left[a].eqNullSafe(right[b]) if null_equal else left[a] == right[b] for a, b in keys]
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Column | None = None, null_equal: bool = False) -> DataFrame:
    """Equi-join with a residual condition, which for outer joins decides matches and never filters the kept side."""
    condition = on_keys(left, right, keys, null_equal)
    return left.join(right, condition if residual is None else condition & residual, how)


def semi(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], residual: Column | None = None) -> DataFrame:
    return join(left, right, keys, "left_semi", residual)


def anti(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], residual: Column | None = None) -> DataFrame:
    """Rows of left without a match, NULL keys kept (NOT EXISTS)."""
    return join(left, right, keys, "left_anti", residual)


def _facts(right: DataFrame, key: str) -> DataFrame:
    """One row: whether right has rows, and whether it has a NULL key."""
    return right.agg((F.count("*") > 0).alias("__any"), (F.count(F.when(F.col(key).isNull(), 1)) > 0).alias("__null"))


def mark(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "mark") -> DataFrame:
    """left with a three-valued column for ``left_key IN (right)``.

    One shuffle join on distinct keys and one row of facts about right; no side has to fit anywhere.
    """
    keys = right.select(F.col(right_key).alias("__key")).filter("__key IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    both = left.join(keys, left[left_key] == F.col("__key"), "left").crossJoin(F.broadcast(_facts(right, right_key)))
    value = F.when(~F.col("__any"), F.lit(False)).when(F.col("__hit"), F.lit(True)).when(F.col(left_key).isNull() | F.col("__null"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return both.withColumn(name, value).drop("__key", "__hit", "__any", "__null")


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left_key NOT IN (right)``: an empty right keeps all, a NULL in right keeps none, a NULL key stays only with an empty right.

    A plain NOT IN makes Spark broadcast the whole right side; this shuffles both sides instead, at any size.
    """
    return mark(left, right, left_key, right_key, "__mark").filter(~F.col("__mark")).drop("__mark")


def one_row(left: DataFrame, value: DataFrame) -> DataFrame:
    """left with the columns of a single-row table; NULLs for none, an error for several."""
    names = value.columns
    checked = value.agg(*(F.when(F.count("*") > 1, F.raise_error(F.lit("more than one row returned by a subquery used as a value"))).otherwise(F.first(f"`{c}`")).cast(dict(value.dtypes)[c]).alias(c) for c in names))
    return left.crossJoin(F.broadcast(checked))


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join without equal keys; the smaller side is broadcast only if its size is known to allow it."""
    return left.join(small(right), condition, how)


def salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join on a hot key (a column of both): left rows are dealt over salts, right rows repeated for each.

    For inner and left joins; adaptive execution splits most skew by itself, this is for keys it can't split, as
    those with several million rows behind an aggregation.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting the left side is not right for {how}")
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "__salt"], how).drop("__salt")
