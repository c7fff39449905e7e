"""Parquet tables by name: paths and patterns, one schema for all files, and column overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import sem


class SchemaMismatchError(ValueError):
    """Files of one table with different columns."""


def expand(spark: SparkSession, path: str) -> list[str]:
    """The files and folders a path or pattern names, sorted, in whatever file system Spark reads it from."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    names = sorted(str(f.getPath().toString()) for f in found) if found is not None else []
    if not names:
        raise FileNotFoundError(f"no file matches {path}")
    return names


def same_schema(spark: SparkSession, paths: list[str]) -> T.StructType:
    """The common schema of all paths, from their footers; nullability aside they must be identical."""
    first = spark.read.parquet(paths[0]).schema
    shape = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    for p in paths[1:]:
        other = spark.read.parquet(p).schema
        if shape(other) != shape(first):
            raise SchemaMismatchError(f"{p} has columns {shape(other)}, {paths[0]} has {shape(first)}")
    return first


def read_table(spark: SparkSession, paths: str | list[str], dates: tuple[str, ...] = (), check: bool = True) -> DataFrame:
    """A table of Parquet files: comma-separated paths or patterns.

    FLOAT columns are widened to DOUBLE; columns in dates hold day numbers and become DATE.  The projection leaves
    column pruning and filter push-down to the scan as they are.
    """
    names = [n for p in (paths.split(",") if isinstance(paths, str) else paths) for n in expand(spark, p.strip())]
    if check:
        same_schema(spark, names)
    df = spark.read.parquet(*names)
    overridden = {d.lower() for d in dates}
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name.lower() in overridden:
            c = sem.day_number(c)
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        made.append(c.alias(f.name))
    return df.select(*made) if overridden or any(isinstance(f.dataType, T.FloatType) for f in df.schema.fields) else df


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) with SQL type names; nested types are named as unsupported."""
    names = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN", "binary": "BLOB", "decimal(38,0)": "HUGEINT"}
    out = []
    for name, kind in df.dtypes:
        out.append((name, names.get(kind) or (kind.upper() if kind.startswith("decimal") else f"unsupported({kind})")))
    return out
