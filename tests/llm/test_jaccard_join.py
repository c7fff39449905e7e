import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import jaccard_join


def brute(rows, k, percent):
    sets = []
    for d, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    name = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return Counter((rows[i][0], len(sets[i]), name[find(i)], len(ids[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_components_equal_brute_force(docs, rows, k, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_in_component) for r in jaccard_join.similar_components(docs, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_row_blocks_split_without_losing_links(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", 2)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_in_component) for r in jaccard_join.similar_components(docs, 2, 60).collect())
    assert got == brute(rows, 2, 60)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_a_large_group_of_near_copies_is_one_component(spark, monkeypatch, broadcast):
    """In many blocks, with others that share its rare shingles but are not like it; each row stands once in a block."""
    import random

    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", 25)
    monkeypatch.setattr(jaccard_join, "BROADCAST_GROUPS", broadcast)
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base = [word() for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(base)
        w[rnd.randrange(60)] = word()
        if i % 40 == 7:  # shares half, and is like its own kind only
            w = w[:30] + [f"other{j}" for j in range(30 + i % 3)]
        if i % 60 == 11:  # longer, in another size class
            w = [*w, *(word() for _ in range(14))]
        rows.append((i, " ".join(w)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_in_component) for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, 80).collect())
    assert got == brute(rows, 2, 80)
    assert max(k[3] for k in got) > 200


def test_one_of_each_and_names(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "u v w x y z"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS row_key", "8 AS _doc_id", "9 AS stays")
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter((*r, 7, 8, 9) for r in (rows[0], rows[3], rows[4]))


def test_empty_table(no_docs):
    assert jaccard_join.similar_components(no_docs, 4, 85).count() == 0
