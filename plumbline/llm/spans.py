"""Cutting spans out of texts: what the deduplicating operators share at their end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import exchange as ex

#: What a block answers: removed spans of some rows as (start << 32 | end), in code points.
ANSWER = "doc_id long, row_key long, spans array<long>"
#: Stands for a null id, behind all others.
LAST = np.iinfo(np.int64).max


def answers(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """One row for each document with its spans."""
    order = np.lexsort((ends, starts, docs, keys))
    docs, keys, packed = docs[order], keys[order], (starts[order].astype(np.int64) << 32) | ends[order].astype(np.int64)
    head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    cuts = np.append(head, len(keys)) if len(keys) else np.zeros(1, dtype=np.int64)
    return pa.table({"doc_id": pa.array(docs[head], pa.int64(), mask=docs[head] == LAST), "row_key": pa.array(keys[head], pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(packed, pa.int64()))})


def merged(found: DataFrame) -> DataFrame:
    """(doc_id, row_key, spans) with all spans of a row, ascending."""
    return found.groupBy("doc_id", "row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def kept(text: str, spans: list[int]) -> str:
    """The text without its spans (ascending, possibly overlapping)."""
    out, at = [], 0
    for s in spans:
        start, end = s >> 32, s & 0xFFFFFFFF
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, all columns, with removed spans cut out of text, and two columns more: removed_spans (null: none) and
    removed_chars; columns of these names are replaced.  found is (doc_id, row_key, spans) of keyed rows."""
    docs = ex.small_batches(docs.drop("removed_spans", "removed_chars"))
    names = docs.columns
    key, doc = (ex.unused(names, n) for n in ("row_key", "doc_id"))
    found = found.select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("spans").alias("removed_spans")).hint("shuffle_hash")
    both = docs.join(found, (ex.row_key() == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").select(*(F.col(f"`{n}`") for n in names), "removed_spans")
    schema = T.StructType([*both.schema.fields, T.StructField("removed_chars", T.LongType())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            spans, text = batch.column("removed_spans"), batch.column("text")
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            gone = np.zeros(len(text), dtype=np.int64)
            if len(hit):
                old = text.take(pa.array(hit)).to_pylist()
                new = [kept(t, s) for t, s in zip(old, spans.take(pa.array(hit)).to_pylist(), strict=True)]
                gone[hit] = [len(a) - len(b) for a, b in zip(old, new, strict=True)]
                mask = np.zeros(len(text), dtype=bool)
                mask[hit] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            columns = [text if name == "text" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=[*batch.schema.names, "removed_chars"])

    return both.mapInArrow(run, schema)


def as_text(column: str) -> F.Column:
    """Spans as start:end, comma-joined; empty where there are none."""
    one = F.transform(F.col(column), lambda s: F.concat_ws(":", F.shiftright(s, 32), s.bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.coalesce(F.array_join(one, ","), F.lit(""))
