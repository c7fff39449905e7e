"""Substring dedup by hashing normalised units of text.

Units are paragraphs (blank lines part them), lines, and the sentences of a line (a word that ends in ``.``, ``!`` or ``?``
ends one).  A unit is normalised by lower-casing A-Z and by taking its words only (white space does not count), and gets
a digest of two independent 64-bit hashes.  Digests are grouped globally; the occurrence with the smallest (doc_id,
offset) stays and all others repeat it.  Repeated paragraphs and lines of some words go.  A repeated sentence alone is
seldom a copy, so sentences go where enough of them repeat one after another: that finds a passage also inside of
longer lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import exchange as ex
from plumbline.llm import spans
from plumbline.llm import textcore as tc

#: Words that a removed paragraph, line or run of sentences has, at least.
MIN_WORDS = 20
#: Words that a sentence has to be looked at, and words that may stand between two sentences of a run.
SENTENCE_WORDS, BETWEEN = 2, 2
#: word is the place of a sentence's first word and n how many it has; n is 0 for lines and paragraphs, which go as they are.
UNIT = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("end", "<i4"), ("word", "<i4"), ("n", "<i4")])
GONE = np.dtype([("key", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("end", "<i4"), ("word", "<i4"), ("n", "<i4")])
LAST = spans.LAST


def units(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, key: np.ndarray, min_words: int) -> np.ndarray:
    """The units of some documents, with offsets in code points of their document; end is where the next word begins."""
    words = tc.Words(data, offsets, tc.NON_SPACE)
    n = len(words.starts)
    if not n:
        return np.zeros(0, dtype=UNIT)
    lines = np.cumsum(data == 10)[words.starts]
    of = words.doc_of()
    other = of[1:] != of[:-1]
    paragraph = np.append(True, (lines[1:] - lines[:-1] > 1) | other)
    line = np.append(True, (lines[1:] != lines[:-1]) | other)
    stop = np.isin(data[words.ends - 1], np.frombuffer(b".!?", dtype=np.uint8))
    sentence = line | np.append(False, stop[:-1])
    points, second = tc.code_points(data), words.second_hashes()
    nexts = np.append(words.starts[1:], 0)
    last = words.doc_first[1:][words.counts > 0] - 1
    nexts[last] = offsets[1:][words.counts > 0]
    made = []
    for begins, finer in ((sentence, None), (line, sentence), (paragraph, line)):
        a = np.flatnonzero(begins)
        b = np.append(a[1:], n)
        size = b - a
        if finer is None:
            keep = size >= SENTENCE_WORDS
        else:  # one that has a single part of the finer kind is that part
            parts = np.add.reduceat(finer.astype(np.int64), a)
            keep = (size >= min_words) & (parts > 1)
        a, b, size = a[keep], b[keep], size[keep]
        out = np.zeros(len(a), dtype=UNIT)
        out["h1"], out["h2"] = tc.sequence_hashes(words.hashes, a, b), tc.sequence_hashes(second, a, b)
        d = of[a]
        out["doc"], out["key"] = doc[d], key[d]
        base = points[offsets[d]]
        out["start"], out["end"] = points[words.starts[a]] - base, points[nexts[b - 1]] - base
        out["word"], out["n"] = a - words.doc_first[d], size if finer is None else 0
        made.append(out)
    return np.concatenate(made)


def repeats(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by digest and rank without those that say the same twice, and which are not the first of their digest."""
    rows = rows[np.lexsort((rows["start"], rows["key"], rows["doc"], rows["h2"], rows["h1"]))]
    if not len(rows):
        return rows, np.zeros(0, dtype=bool)
    same = (rows["h1"][1:] == rows["h1"][:-1]) & (rows["h2"][1:] == rows["h2"][:-1])
    twice = np.append(False, same & (rows["key"][1:] == rows["key"][:-1]) & (rows["doc"][1:] == rows["doc"][:-1]) & (rows["start"][1:] == rows["start"][:-1]))
    return rows[~twice], np.append(False, same)[~twice]


def _gone(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=GONE)
    for name in GONE.names:
        out[name] = rows[name]
    return out


def chosen(gone: np.ndarray, min_words: int) -> np.ndarray:
    """Of the repeated units those that go: lines and paragraphs, and sentences in runs of so many words."""
    gone = np.unique(gone)
    wide, gone = gone[gone["n"] == 0], gone[gone["n"] > 0]
    gone = gone[np.lexsort((gone["word"], gone["doc"], gone["key"]))]
    if not len(gone):
        return wide
    gap = gone["word"][1:] - gone["word"][:-1] - gone["n"][:-1]
    run = np.cumsum(np.append(True, (gone["key"][1:] != gone["key"][:-1]) | (gone["doc"][1:] != gone["doc"][:-1]) | (gap > BETWEEN))) - 1
    return np.concatenate([wide, gone[np.bincount(run, weights=gone["n"])[run] >= min_words]])


def removals(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row_key, spans) to remove from keyed rows."""
    blocks = ex.block_count(rows)

    def per_chunk(batch, data, offsets, first, last):  # noqa: ANN001, ANN202
        doc, key = (ex.int64s(batch.column(c).slice(first, last - first), LAST) for c in ("doc_id", "row_key"))
        return units(data, offsets, doc, key, min_words)

    def flush(parts: list) -> list:
        found, again = repeats(np.concatenate(parts))
        gone, asked = _gone(found[again]), found[~again]
        return [ex.pack((asked["h1"] % np.uint64(blocks)).astype(np.int32), 0, asked), ex.pack((gone["key"] % blocks).astype(np.int32), 1, gone)]

    def at_block(table: pa.Table) -> pa.Table:
        found, again = repeats(ex.unpack(table, 0, UNIT))
        gone = np.concatenate([_gone(found[again]), ex.unpack(table, 1, GONE)])
        batch = ex.pack((gone["key"] % blocks).astype(np.int32), 1, gone)
        return pa.Table.from_batches([batch] if batch else [], schema=ex.PACKED_ARROW)

    def by_row(table: pa.Table) -> pa.Table:
        gone = chosen(ex.unpack(table, 1, GONE), min_words)
        return spans.answers(gone["doc"], gone["key"], gone["start"], gone["end"])

    sent = rows.mapInArrow(ex.map_flushed(per_chunk, flush, blocks), ex.PACKED)
    return sent.groupBy("block").applyInArrow(at_block, ex.PACKED).groupBy("block").applyInArrow(by_row, spans.ANSWER)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with repeated units cut out of text; removed_spans (ascending start << 32 | end, code points of
    the original text; null: none) and removed_chars are added, in place of columns of these names.

    Repeated are all occurrences of a unit but that with the smallest (doc_id, offset), a null doc_id ranking last and ids
    shared by different texts ranking by a hash of the text.  Paragraphs and lines go from min_words words on; sentences
    where neighbouring repeated ones, with at most BETWEEN words between two, have as many together.  Shorter boilerplate
    stays.  A unit is cut with the white space behind it.  Null, empty and blank texts have no units and come back as they
    are.  Rows equal in doc_id and text are one document: each comes back, with the same result.  Extra columns are kept.
    """
    return spans.cut(docs, removals(ex.keyed(docs), min_words))
