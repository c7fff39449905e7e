import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import exchange as ex
from plumbline.llm import textcore as tc

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aZé ß\n\t.0_世-\x0b ", max_size=40)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_and_shingles_equal_regular_expressions(texts, k):
    data, offsets = tc.buffers(pa.array(texts, pa.string()))
    for table, pattern in ((tc.WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (tc.NON_SPACE, r"[^\x20\x09-\x0D]+")):
        words = tc.Words(data, offsets, table)
        want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        assert words.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        got = [data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
        assert [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in got] == flat
        same = {}
        for h, w in zip(words.hashes.tolist(), flat, strict=True):
            assert same.setdefault(w, h) == h
        assert len(set(same.values())) == len(same)
        hashes, cuts = words.shingle_sets(k)
        for ws, a, b in zip(want, cuts[:-1], cuts[1:], strict=True):
            n = len({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}) if len(ws) >= k else min(1, len(ws))
            assert b - a == n and (np.diff(hashes[a:b].astype(object)) > 0).all()


def test_slices_and_nulls_of_arrow_columns():
    column = pa.array(["skipped", None, "ä b", ""], pa.string()).slice(1)
    data, offsets = tc.buffers(column)
    assert data.tobytes().decode() == "ä b" and offsets.tolist() == [0, 0, 4, 4]
    assert tc.code_points(data).tolist() == [0, 1, 1, 2, 3]
    assert list(tc.chunks(np.array([0, 5, 5, 20, 21]), most=6)) == [(0, 2), (2, 3), (3, 4)]


def test_packed_records_come_back():
    kind = np.dtype([("a", "<u4"), ("b", "<i8")])
    records = np.array([(i, -i) for i in range(100)], dtype=kind)
    batch = ex.pack((records["a"] % 7).astype(np.int32), 3, records)
    assert batch.num_rows == 7 and ex.pack(np.zeros(0, np.int32), 3, records[:0]) is None
    back = ex.unpack(pa.Table.from_batches([batch, batch]), 3, kind)
    assert sorted(back.tolist()) == sorted(records.tolist() * 2)
    assert len(ex.unpack(pa.Table.from_batches([batch]), 4, kind)) == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_bitmap_has_no_false_negatives(spark, n):
    from pyspark.sql import functions as F

    made = ex.bitmap(spark.range(n).select(F.xxhash64("id").alias("h")), "h")
    have = np.array([r.h for r in spark.range(n).select(F.xxhash64("id").alias("h")).collect()], dtype=np.int64).view(np.uint64)
    assert made.may_have(have).all()
    others = tc.mix64(np.arange(1, 100001, dtype=np.uint64))
    assert made.may_have(others).mean() < 0.01


@pytest.mark.parametrize("held", [1 << 20, 300])
def test_components_equal_union_find(spark, held, monkeypatch):
    """In one task, and in rounds of many."""
    monkeypatch.setattr(ex, "TASK_EDGES", held)
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)]
    edges += [(1000, 1001 + i) for i in range(3000)]  # a hub
    edges += [(5000 + i, 5001 + i) for i in range(300)]  # a chain
    edges += [(7, 7), edges[0], edges[0][::-1]]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    alone = {x for e in edges for x in e} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in ex.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent if x not in alone}
    assert ex.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sizes_grow_with_the_input():
    """A packed row holds several records at any size, and no block or flush is beyond its bound."""
    for total in (10**6, 10**9, 10**12, 10**14):
        size = min(ex.MOST_BLOCK_BYTES, max(ex.BLOCK_BYTES, 10 * int(total**0.5)))
        blocks = total // size + 1
        assert ex.flush_bytes(blocks) <= ex.MOST_FLUSH_BYTES
        assert ex.flush_bytes(blocks) / 6 / blocks > 8  # words of six bytes


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        ex.shared_folder(type("S", (), {"sparkContext": Context()})())
