"""Sorting, limits and late materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.functions.sem import last_nulls


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """Total sort, a leading - for descending, NULLs last."""
    return df.orderBy(*last_nulls(*keys))


def top(df: DataFrame, keys: list[str], n: int, offset: int = 0) -> DataFrame:
    """ORDER BY .. LIMIT n OFFSET m: each task keeps n + m rows, nothing is sorted in full."""
    out = df.orderBy(*last_nulls(*keys)).limit(n + offset)
    return out.offset(offset) if offset else out


def late_top(df: DataFrame, row_id: list[str], keys: list[str], n: int) -> DataFrame:
    """Top n of a wide table: the winners are found in a scan of keys and row ids only, then their other columns are read.

    row_id must tell rows apart; the n winners are a bounded broadcast.
    """
    from pyspark.sql import functions as F

    names = [k.lstrip("-") for k in keys]
    winners = top(df.select(*dict.fromkeys([*row_id, *names])), keys, n).select(*row_id)
    return top(df.join(F.broadcast(winners), row_id, "left_semi"), keys, n)
