"""Benchmark decontamination: a prefix-filtered set join of documents with windows of benchmark items.

A window is 10 consecutive words of an item (an item of fewer words is one window).  As a set it has the shingles of
up to 5 words in it, and a document contains the window only if it has all of them, so the necessary prefix of a
window under a containment of 1 is its first shingle in the order of rarity.  Rarity is counted over the whole corpus,
for shingles that the benchmark has.  Documents are joined on these prefix shingles only; the shingle's place gives
where the window would begin (positional bound) and end (length bound), and the words there are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex
from plumbline.llm import textcore as tc

WINDOW = 10
SHINGLE = 5
#: Bytes up to which the table of windows, and that of the items they are from, is broadcast; beyond, the join is a shuffle with skew splitting.
BROADCAST_BYTES = 16 << 20
WINDOW_COLUMNS = "item_id string, window_words int, k int, offset int, h long, window_id long, window string"
CANDIDATE = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("place", pa.int32()), ("k", pa.int32()), ("before", pa.int32()), ("h", pa.int64()), ("context", pa.string())])


def _joined(words: tc.Words, lower: bytes, start: int, end: int) -> str:
    """Words start..end of a document, joined by single spaces."""
    return b" ".join(lower[a:b] for a, b in zip(words.starts[start:end].tolist(), words.ends[start:end].tolist(), strict=True)).decode("utf-8", "replace")


def _lower(data: np.ndarray) -> bytes:
    table = bytes([*range(65), *range(97, 123), *range(91, 256)])
    return data.tobytes().translate(table)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """A row for each shingle of each window."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            words, lower, ids = tc.Words(data, offsets), _lower(data), batch.column("item_id")
            shingles = {}
            for k in range(1, SHINGLE + 1):
                h, at = words.shingles(k)
                shingles[k] = dict(zip(at.tolist(), h.view(np.int64).tolist(), strict=True))
            out = []
            for d in range(len(offsets) - 1):
                first, last = int(words.doc_first[d]), int(words.doc_first[d + 1])
                size = min(WINDOW, last - first)
                k = min(SHINGLE, size)
                for start in range(first, last - size + 1) if size else ():
                    text = _joined(words, lower, start, start + size)
                    name = int(tc.sequence_hashes(words.hashes, np.array([start]), np.array([start + size])).view(np.int64)[0])
                    out += [(ids[d].as_py(), size, k, o, shingles[k][start + o], name, text) for o in range(size - k + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if any(x[0] is not None for x in out) else [pa.array([None] * len(out), pa.string()), *(pa.array(c) for c in list(zip(*out, strict=True))[1:])], names=[x.split()[0] for x in WINDOW_COLUMNS.split(", ")]).cast(pa.schema([("item_id", pa.string()), ("window_words", pa.int32()), ("k", pa.int32()), ("offset", pa.int32()), ("h", pa.int64()), ("window_id", pa.int64()), ("window", pa.string())]))

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, WINDOW_COLUMNS)


def _shingle_counts(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, n) of the benchmark's shingles in the corpus, combined in every task before the shuffle."""
    known = rows.sparkSession.sparkContext.broadcast(ex.bitmap(windows.select("h").distinct(), "h"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            parts = []
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                words = tc.Words(data[own[0] : own[-1]], own - own[0])
                for k in sizes:
                    h, _ = words.shingles(k)
                    parts.append(h[known.value.may_have(h)])
            h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _candidates(rows: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each document (of no k: 0), and one for each place where a prefix shingle may be."""
    known = rows.sparkSession.sparkContext.broadcast(ex.bitmap(prefixes.select("h").distinct(), "h"))
    reach = WINDOW - SHINGLE

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                part = data[own[0] : own[-1]]
                words = tc.Words(part, own - own[0])
                key, doc = (batch.column(c).slice(first, last - first) for c in ("row_key", "doc_id"))
                n = last - first
                none = pa.nulls(n, pa.int32())
                # k and h meet nothing in the join, and deal these rows evenly
                yield pa.RecordBatch.from_arrays([key, doc, pa.array(words.counts, pa.int64()), none, pa.array(np.zeros(n, np.int32)), none, key, pa.nulls(n, pa.string())], schema=CANDIDATE)
                lower, of = None, words.doc_of()
                for k in sizes:
                    h, at = words.shingles(k)
                    met = np.flatnonzero(known.value.may_have(h))
                    if not len(met):
                        continue
                    h, at = h[met], at[met]
                    lower = _lower(part) if lower is None else lower
                    d = of[at]
                    low = np.maximum(at - reach, words.doc_first[d])
                    high = np.minimum(at + k + reach, words.doc_first[d + 1])
                    context = [_joined(words, lower, a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(d)), doc.take(pa.array(d)), pa.array(words.counts[d], pa.int64()), pa.array((at - words.doc_first[d]).astype(np.int32)), pa.array(np.full(len(d), k, np.int32)), pa.array((at - low).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(context, pa.string())], schema=CANDIDATE)

    return rows.mapInArrow(run, "row_key long, doc_id long, n_words long, place int, k int, before int, h long, context string")


def _small(df: DataFrame, *texts: str) -> bool:
    """Whether a table of some texts, and a few numbers in each row, has BROADCAST_BYTES at most."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(64))
    return (df.agg(F.sum(size).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_key, doc_id, n_words, n_hit, items, rows) of every distinct document.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  n_hit counts document words inside any
    occurrence of a window; items are the ids, as strings and sorted, of items with occurring windows.  Null, empty and
    wordless texts have no words and no hits; items without words have no windows; an item whose id is null counts
    for n_hit only.  rows is how often a row, equal in doc_id and text, is in the table.  Extra columns are ignored.
    """
    rows = ex.keyed(docs)
    windows = ex.checkpoint(benchmark_windows(benchmark))
    distinct = windows.dropDuplicates(["window_id", "window", "offset"])
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # five at most
    rarity = _shingle_counts(rows, distinct, sizes)
    rarest = F.min_by(F.struct("offset", "h"), F.struct(F.coalesce("n", F.lit(0)), "h", "offset")).alias("p")
    prefixes = ex.checkpoint(distinct.join(rarity, "h", "left").groupBy("window", "window_words", "k").agg(rarest).select("window", "window_words", "k", "p.offset", "p.h"))
    owners = windows.select("window", "item_id").filter("item_id IS NOT NULL").distinct()
    found = _candidates(rows, prefixes, sizes).alias("c")
    w = (F.broadcast(prefixes) if _small(prefixes, "window") else prefixes).alias("w")
    start = F.col("place") - F.col("offset")
    placed = found.join(w, (F.col("c.h") == F.col("w.h")) & (F.col("c.k") == F.col("w.k")) & (start >= 0) & (start + F.col("window_words") <= F.col("n_words")), "left")
    there = F.array_join(F.expr("slice(split(context, ' '), before - offset + 1, window_words)"), " ")
    held = placed.select("row_key", "doc_id", "n_words", (F.col("c.k") == 0).alias("whole"), F.when(there == F.col("window"), F.col("window")).alias("window"), start.alias("start"), "window_words").filter("whole OR window IS NOT NULL")
    by_row = ex.checkpoint(
        held.groupBy("row_key", "doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.sum(F.col("whole").cast("long")).alias("rows"),
            F.collect_set(F.when(F.col("window").isNotNull(), F.struct("start", "window_words"))).alias("places"),
            F.collect_set("window").alias("windows"),
        )
    )
    # items come as rows, for the few documents with a window: a window that very many items share makes no wide row
    hit = by_row.filter(F.size("windows") > 0).select(F.col("row_key").alias("key"), F.col("doc_id").alias("id"), F.explode("windows").alias("window"))
    items = hit.join(F.broadcast(owners) if _small(owners, "window", "item_id") else owners, "window").groupBy("key", "id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    named = by_row.join(items, (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["window_words"] - 1))))
    return named.select("row_key", "doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "rows")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with a digest of the items, one row for each row of docs."""
    found = contamination(docs, benchmark)
    each = found.withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
    return each.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that contain no window of the benchmark."""
    key, doc = (ex.unused(docs.columns, n) for n in ("row_key", "doc_id"))
    hit = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("row_key").alias(key), F.col("doc_id").alias(doc))
    return docs.join(hit, (ex.row_key() == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_anti")
