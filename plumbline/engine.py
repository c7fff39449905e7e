"""The engine: a catalogue of Parquet tables and queries over them in DuckDB's dialect."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.errors import AnalysisException, ParseException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame, SparkSession

from plumbline.dialect import DialectError, Translator
from plumbline.session import prepared
from plumbline.sources import parquet_tables


@contextmanager
def _quietly() -> Iterator[None]:
    """Without a line in the log for each expression that Catalyst can't analyse as it stands: the answer is what is asked for."""
    logger = PySparkLogger.getLogger("SQLQueryContextLogger")
    was, logger.disabled = logger.disabled, True
    try:
        yield
    finally:
        logger.disabled = was


class Engine:
    """SQL text over registered tables.  Nothing runs before a result is read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = prepared(spark)
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, paths: str | list[str], dates: tuple[str, ...] = (), check: bool = True) -> DataFrame:
        """Registers Parquet files, or a pattern of them, under a case-insensitive name."""
        df = parquet_tables.read_table(self.spark, paths, dates, check)
        return self.register_frame(name, df)

    def register_frame(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self.tables[name.lower()] = df
        return df

    def schema(self, name: str) -> list[tuple[str, str]]:
        return parquet_tables.describe(self.tables[name.lower()])

    def _types(self, text: str) -> list[str] | None:
        try:
            with _quietly():
                return [kind for _, kind in self.spark.sql(text).dtypes]
        except (AnalysisException, ParseException):
            return None

    def _columns(self, text: str) -> list[str] | None:
        try:
            with _quietly():
                return self.spark.sql(text).columns
        except (AnalysisException, ParseException):
            return None

    def translate(self, text: str, first_of_group: bool = False) -> tuple[str, list[str]]:
        """Spark SQL text, and the helper columns at the end that a caller drops."""
        made = Translator(lru_cache(maxsize=None)(self._types), self._columns, first_of_group)
        spark_text = made.statement(text)
        if made.unknown:
            self.spark.sql(spark_text)  # what is wrong with the statement itself is said first
            raise DialectError(f"can't tell the type of {made.unknown[0]}; name its table or cast it")
        return spark_text, made.hidden

    def sql(self, text: str) -> DataFrame:
        try:
            spark_text, hidden = self.translate(text)
            df = self.spark.sql(spark_text)
        except AnalysisException as e:
            if e.getCondition() is None or "SCALAR_SUBQUERY_IS_IN_GROUP_BY" not in e.getCondition():
                raise
            spark_text, hidden = self.translate(text, first_of_group=True)
            df = self.spark.sql(spark_text)
        return df.drop(*hidden) if hidden else df

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan as text: extended, formatted, cost or codegen; analyze runs the query and gives the final plan."""
        df = self.sql(text)
        execution = df._jdf.queryExecution()
        if mode == "analyze":
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            return f"{execution.executedPlan().treeString()}\nseconds: {time.perf_counter() - began:.3f}"
        modes = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode
        return execution.explainString(modes.fromString(mode))

    def bench(self, queries: list[str], tries: int = 3) -> list[list[float | None]]:
        """Seconds of each try of each query, results thrown away; None where a query is refused."""
        out: list[list[float | None]] = []
        for q in queries:
            times: list[float | None] = []
            for _ in range(tries):
                began = time.perf_counter()
                try:
                    self.sql(q).write.format("noop").mode("overwrite").save()
                    times.append(round(time.perf_counter() - began, 6))
                except (AnalysisException, ParseException, DialectError):
                    times.append(None)
            out.append(times)
        return out
