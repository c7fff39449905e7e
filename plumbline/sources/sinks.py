"""Where results go: text on a stream, or files that executors write."""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import json
import math
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_text(v: object) -> str | None:
    """A value as text: shortest doubles, plain decimals, ISO dates; None for NULL."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def csv_lines(df: DataFrame) -> Iterator[str]:
    """Header and rows; rows stream from executors one partition at a time."""
    def line(values: list) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(values)
        return out.getvalue()

    yield line(df.columns)
    for row in df.toLocalIterator():
        yield line(["" if (t := value_text(v)) is None else t for v in row])


def json_lines(df: DataFrame) -> Iterator[str]:
    """One object for each row; decimals are strings, so that none is rounded, and non-finite doubles too."""
    for row in df.toLocalIterator():
        yield json.dumps({k: (v if v is None or isinstance(v, (bool, int, str)) or isinstance(v, float) and math.isfinite(v) else value_text(v)) for k, v in zip(df.columns, row, strict=True)}, ensure_ascii=False)


def table_lines(df: DataFrame, most: int = 1000) -> Iterator[str]:
    """An aligned table of the first rows, and how many there are beyond them."""
    rows = [["NULL" if (t := value_text(v)) is None else t for v in r] for r in df.limit(most + 1).collect()]
    shown = [df.columns, *rows[:most]]
    widths = [max(len(r[i]) for r in shown) for i in range(len(df.columns))]
    for i, r in enumerate(shown):
        yield " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
        if not i:
            yield "-+-".join("-" * w for w in widths)
    if len(rows) > most:
        yield f"(more than {most} rows)"


FORMATS = {"table": table_lines, "csv": csv_lines, "json": json_lines}


def print_result(df: DataFrame, form: str, out: TextIO) -> None:
    for text in FORMATS[form](df):
        out.write(text + "\n")


def write_result(df: DataFrame, path: str, form: str = "parquet", mode: str = "error") -> None:
    """Files written by executors in parallel; decimals go to JSON and CSV as text."""
    if form in ("csv", "json"):
        df = df.select(*(F.col(f"`{n}`").cast("string").alias(n) if k.startswith("decimal") else F.col(f"`{n}`") for n, k in df.dtypes))
    writer = df.write.mode(mode)
    if form == "csv":
        writer = writer.option("header", "true")
    writer.format(form).save(path)
