import hashlib
import re
from collections import Counter

import pytest

from plumbline.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    out = []
    for d, t, *_ in rows:
        w = words(t)
        hit, ids = set(), set()
        for item, text in items:
            iw = words(text)
            size = min(10, len(iw))
            for a in range(len(iw) - size + 1) if size else ():
                for s in range(len(w) - size + 1):
                    if w[s : s + size] == iw[a : a + size]:
                        hit.update(range(s, s + size))
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    passage = [r[1] for r in rows if r[1] and len(words(r[1])) > 60][:3]
    cut = [" ".join(words(p)[5 + i : 30 + 3 * i]).upper() for i, p in enumerate(passage)]
    return [*enumerate(cut), (10, cut[0]), (11, "Not in any text, surely not in any of these texts at all"), (12, " ".join(words(passage[0])[40:44])), (13, words(passage[1])[0]), (14, None), (15, ""), (16, "...!"), (17, " ".join(words(passage[2])[:7]))]


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_report_equals_brute_force(spark, docs, rows, items, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.report(docs, bench).collect())
    want = brute(rows, items)
    assert got == want
    assert sum(k[5] for k in want) > 5


def test_clean_keeps_the_rest(spark, docs, rows, items):
    bench = spark.createDataFrame(items[:3], "item_id long, text string")
    want = Counter(k[0] for k, n in brute(rows, items[:3]).items() for _ in range(n) if not k[5])
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_empty_tables(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).filter("contaminated").count() == 0
    assert decontaminate.report(docs, none).count() == len(rows)
    assert decontaminate.report(no_docs, none).count() == 0
