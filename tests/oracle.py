"""Comparing a query with DuckDB: rows without order, doubles to nine digits."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") if v else 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def compare(df, connection, sql):
    """Asserts equal columns and rows; returns the column types of both."""
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(norm(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want
    return {c: (dict(df.dtypes)[c], kinds[c]) for c in columns}
