import hashlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import exchange as ex
from plumbline.llm import spotsigs


@pytest.mark.parametrize("run_rows", [4000, 20])
def test_edit_report_equals_brute_force(docs, rows, run_rows, monkeypatch):
    monkeypatch.setattr(spotsigs, "RUN_ROWS", run_rows)
    keys = {(r.doc_id, r.text): r.row_key for r in ex.keyed(docs).collect()}
    order = sorted([r[:2] for r in rows], key=lambda r: (-(1 << 63) if r[0] is None else r[0], -keys[r]), reverse=True)
    want = Counter()
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = spotsigs.fingerprints([t, e, nxt])
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), *spotsigs.encoded([a, b]), spotsigs.likeness(a, b), spotsigs.likeness(a, c))] += 1
    out = spotsigs.edit_report(docs).collect()
    assert Counter(tuple(r)[:7] for r in out) == want
    near = Counter((r.doc_id, r.component_id, r.n_in_component) for r in spotsigs.near_duplicates(docs).collect())
    assert Counter((r.doc_id, r.component_id, r.n_in_component) for r in out) == near


def test_one_id_with_many_rows_is_cut_into_runs(spark, monkeypatch):
    """A null id, and one id, with a third of all rows each: no run has many more rows than others, and the order holds."""
    import numpy as np

    monkeypatch.setattr(spotsigs, "RUN_ROWS", 50)
    rows = [(i if i % 3 == 0 else None if i % 3 == 1 else 77, f"the row {i} is about a thing number {i} in this text") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = {(r.doc_id, r.text): r.row_key for r in ex.keyed(df).collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], -keys[r]), reverse=True)
    want = Counter()
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        want[d, hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in spotsigs.edit_report(df).collect()) == want
    none = spark.createDataFrame([], "doc_id long, row_key long, component_id long, n_in_component long")
    sizes = [r["count"] for r in spotsigs._neighbours(df, none).filter(f"kind = {spotsigs.OWN}").groupBy("run").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 4 * np.mean(sizes)


def test_signatures_are_anchor_chains():
    one, two, three, four = spotsigs.fingerprints(["The cat of Rome sleeps by the Tiber today", "the CAT -- of rome sleeps! by THE tiber, today.", "cat rome sleeps", ""])
    assert list(one) == list(two)
    assert len(one) == 4  # the-cat-rome, of-rome-sleeps, by-tiber-today, the-tiber-today
    assert len(three) == 3 and len(four) == 0
    assert spotsigs.likeness(four, four) == 1 and spotsigs.likeness(one, four) == 0


def test_near_duplicates_equal_brute_force(docs, rows):
    import numpy as np
    import pyarrow as pa

    from plumbline.llm import textcore as tc

    texts = [r[1] or "" for r in rows]
    data, offsets = tc.buffers(pa.array(texts))
    value, cuts = spotsigs.signatures(data, offsets)
    sets = [set(value[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in spotsigs.near_duplicates(docs, 80).collect())
    assert got == want
    assert np.all(np.diff(cuts) >= 0)


def test_empty_table(no_docs):
    assert spotsigs.edit_report(no_docs).count() == 0
