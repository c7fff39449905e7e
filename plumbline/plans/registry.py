"""A query is a name, a function (spark, sf_dir) -> DataFrame and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered already")
    REGISTRY[name] = Query(name, run, oracle)
