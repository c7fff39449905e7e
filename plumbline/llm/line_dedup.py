"""Line dedup with content-defined chunks of lines.

Lines are hashed; a rolling hash over the hashes of two neighbouring lines is taken at every line, and a chunk ends at
each line whose rolling hash is smaller than both neighbours'.  Boundaries depend on nearby lines only, so they come
back after lines are put in or taken out, and two of them are never in neighbouring lines.  Chunks of several lines
are grouped globally by hash, compared byte by byte, and all but the first of equal chunks are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex
from plumbline.llm import spans
from plumbline.llm import textcore as tc

LAST = spans.LAST
#: Flushes of map tasks that meet at once: of more, some meet first, so a chunk that is everywhere comes to its block from these only.
FAN_IN = 4096
#: A chunk on its way; body is null where it is settled already that it goes.
CHUNK = pa.schema([("block", pa.int32()), ("h", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("body", pa.binary())])


def line_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first byte, end byte) of the chunks of two lines at least; the end is behind the last newline."""
    newline = data == 10
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:][newline] = True
    begins[offsets] = True
    starts = np.flatnonzero(begins[:-1]) if len(data) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(3)))
    ends = np.append(starts[1:], len(data))
    body = ends - (newline[ends - 1]).astype(np.int64)  # a last line without its newline equals one with it
    lines = tc.range_hashes(data, starts, body)
    of = np.searchsorted(offsets, starts, side="right") - 1
    first = np.append(True, of[1:] != of[:-1])
    with np.errstate(over="ignore"):
        before = np.append(np.uint64(0), lines[:-1])
        before[first] = 0
        rolled = tc.mix64(lines * np.uint64(0x9E3779B97F4A7C15) + before)
    smaller = np.zeros(len(lines), dtype=bool)
    smaller[1:-1] = (rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] < rolled[2:]) & ~first[1:-1] & ~first[2:]
    heads = np.flatnonzero(first | np.append(False, smaller[:-1]))
    stops = np.append(heads[1:], len(lines))
    several = stops - heads >= 2
    heads, stops = heads[several], stops[several]
    return tc.sequence_hashes(lines, heads, stops), of[heads], starts[heads], ends[stops - 1]


def _repeats(h: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, body) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Places of the chunks that stay and of those that repeat one of them, judged by their bytes, by rank."""
    order = np.lexsort((start, key, doc, h))
    h = h[order]
    head = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, dtype=bool)
    group = np.cumsum(head) - 1
    stay, go = [order[(np.bincount(group) == 1)[group]]] if len(h) else [order], []
    crowd = order[(np.bincount(group) > 1)[group]] if len(h) else order
    seen: dict[bytes, tuple] = {}
    at, first, again = None, [], []
    hashes = dict(zip(order.tolist(), h.tolist(), strict=True)) if len(crowd) else {}
    for i in crowd.tolist():
        if hashes[i] != at:
            at, seen = hashes[i], {}
        place = (key[i], start[i])
        owner = seen.setdefault(body(i), place)
        if owner == place:
            first.append(i)
        else:
            again.append(i)
    stay.append(np.array(first, dtype=np.int64))
    go.append(np.array(again, dtype=np.int64))
    return np.concatenate(stay), np.concatenate(go)


def removals(rows: DataFrame) -> DataFrame:
    """(doc_id, row_key, spans) to remove from keyed rows."""
    total = ex.text_bytes(rows)
    blocks = ex.blocks_for(rows.sparkSession, total)
    ways = int(total / (ex.flush_bytes(blocks) * FAN_IN)) + 1

    def per_chunk(batch, data, offsets, first, last):  # noqa: ANN001, ANN202
        h, of, start, end = line_chunks(data, offsets)
        doc, key = (ex.int64s(batch.column(c).slice(first, last - first), LAST)[of] for c in ("doc_id", "row_key"))
        points = tc.code_points(data)
        base = points[offsets[of]]
        whole = data.tobytes()
        closed = whole[-1:] == b"\n"
        body = [whole[a:b].removesuffix(b"\n") for a, b in zip(start.tolist(), end.tolist(), strict=True)] if len(h) or closed else []
        return h, doc, key, points[start] - base, points[end] - base, body

    def flush(parts: list) -> list:
        h, doc, key, start, end = (np.concatenate([p[i] for p in parts]) for i in range(5))
        bodies = [b for p in parts for b in p[5]]
        return dealt(h, doc, key, start, end, bodies.__getitem__)

    def dealt(h, doc, key, start, end, body) -> list:  # noqa: ANN001
        stay, go = _repeats(h, doc, key, start, body)
        _, once = np.unique(np.stack([key[stay], start[stay]]), axis=1, return_index=True) if len(stay) else (None, np.zeros(0, dtype=np.int64))
        stay = stay[once]
        out = []
        for at, block, with_body in ((stay, (h[stay] % np.uint64(blocks)).astype(np.int32), True), (go, (key[go] % blocks).astype(np.int32), False)):
            if len(at):
                order = np.argsort(block, kind="stable")
                at, block = at[order], block[order]
                out.append(pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(h[at].view(np.int64)), pa.array(doc[at]), pa.array(key[at]), pa.array(start[at].astype(np.int32)), pa.array(end[at].astype(np.int32)), pa.array([body(i) for i in at.tolist()] if with_body else [None] * len(at), pa.binary())], schema=CHUNK))
        return out

    def some_meet(table: pa.Table) -> pa.Table:
        table = table.select(CHUNK.names).cast(CHUNK)
        settled = table.column("body").is_null()
        bodies = table.filter(pc.invert(settled)).combine_chunks()
        h, doc, key, start, end = (bodies.column(c).to_numpy() for c in ("h", "doc", "key", "start", "end"))
        body = bodies.column("body").combine_chunks()
        return pa.concat_tables([table.filter(settled), pa.Table.from_batches(dealt(h.view(np.uint64), doc, key, start, end, lambda i: body[i].as_py()), schema=CHUNK)])

    def at_block(table: pa.Table) -> pa.Table:
        settled = table.column("body").is_null().to_numpy()
        h, doc, key, start, end = (table.column(c).to_numpy() for c in ("h", "doc", "key", "start", "end"))
        open_ = np.flatnonzero(~settled)
        bodies = table.column("body")
        _, go = _repeats(h[open_], doc[open_], key[open_], start[open_], lambda i: bodies[int(open_[i])].as_py())
        gone = np.concatenate([open_[go], np.flatnonzero(settled)])
        return spans.answers(doc[gone], key[gone], start[gone], end[gone])

    kind = "block int, h long, doc long, key long, start int, end int, body binary"
    sent = rows.mapInArrow(ex.map_flushed(per_chunk, flush, blocks), kind)
    if ways > 1:  # by the task they come from, then all
        sent = sent.withColumn("way", F.pmod(F.spark_partition_id(), F.lit(ways))).groupBy("block", "way").applyInArrow(some_meet, kind)
    return spans.merged(sent.groupBy("block").applyInArrow(at_block, spans.ANSWER))


def dedup(docs: DataFrame) -> DataFrame:
    """docs, all columns, with globally repeated chunks of several lines cut out of text; removed_spans and removed_chars
    are added as in substring_dedup.

    Of equal chunks the one with the smallest (doc_id, offset) stays; a null doc_id ranks last.  A chunk goes with its
    last newline.  Null and empty texts, and texts of one line, have no chunk of several lines and come back as they
    are.  Rows equal in doc_id and text are one document: each comes back, with the same result.  Extra columns are kept.
    """
    return spans.cut(docs, removals(ex.keyed(docs)))

