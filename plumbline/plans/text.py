"""Queries written as SQL text, which the engine translates and DuckDB runs as it is."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plumbline.engine import Engine
from plumbline.plans.registry import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Tables by session and path: their footers and file lists are read once, as in any catalogue of read-only tables.
_known: dict[tuple[str, str], DataFrame] = {}


def engine_for(spark: SparkSession, sf_dir: str, text: str | None = None) -> Engine:
    """An engine with the tables of a folder that a text names (all: without a text)."""
    engine = Engine(spark)
    for t in TABLES:
        if text is None or re.search(rf"\b{t}\b", text, re.I):
            path = f"{sf_dir}/{t}.parquet"
            key = (spark.sparkContext.applicationId, path)
            if key not in _known:
                _known[key] = engine.register(t, path, check=False)
            else:
                engine.register_frame(t, _known[key])
    return engine


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    text = " ".join(line.strip() for line in text.strip().splitlines())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_for(spark, sf_dir, text).sql(text)

    register(name, run, text if oracle is None else oracle)
