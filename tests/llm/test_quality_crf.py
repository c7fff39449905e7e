import itertools
import math

import numpy as np
import pytest

from plumbline.llm import labelled, quality_crf


def labellings(score, pair, first):
    """All labellings of each document with their weights."""
    for a, b in itertools.pairwise(first.tolist()):
        yield a, b, {path: math.exp(sum(score[a + i] for i, s in enumerate(path) if s) + sum(pair[x, y] for x, y in itertools.pairwise(path))) for path in itertools.product((0, 1), repeat=b - a)}


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(3)
    first = np.array([0, 4, 4, 5, 8])
    score, pair = rnd.normal(size=8), rnd.normal(size=(2, 2))
    good, at, joint, logs = quality_crf.forward_backward(score, pair, first)
    want, pairs = np.zeros(8), np.zeros((8, 2, 2))
    for d, (a, b, weights) in enumerate(labellings(score, pair, first)):
        total = sum(weights.values())
        assert a == b or logs[d] == pytest.approx(math.log(total))
        for path, w in weights.items():
            want[a:b] += np.array(path) * w / total
            for i, (x, y) in enumerate(itertools.pairwise(path)):
                pairs[a + i + 1, x, y] += w / total
    assert np.allclose(good, want)
    assert at.tolist() == [1, 2, 3, 6, 7] and np.allclose(joint, pairs[at])


def brute_likelihood(score, pair, first, y):
    """Good documents have good lines only; bad ones have a bad line."""
    out = 0.0
    for d, (a, b, weights) in enumerate(labellings(score, pair, first)):
        if a < b:
            total, best = sum(weights.values()), weights[(1,) * (b - a)]
            out += math.log(best / total if y[d] else (total - best) / total)
    return out


def test_likelihood_and_slopes_equal_enumeration():
    rnd = np.random.default_rng(5)
    first, y = np.array([0, 4, 4, 5, 8, 11]), np.array([1, 0, 0, 0, 1.0])
    score, pair = rnd.normal(size=11), rnd.normal(size=(2, 2))
    value, by_score, by_pair = quality_crf.likelihood(score, pair, first, y)
    assert value == pytest.approx(brute_likelihood(score, pair, first, y))
    h = 1e-6
    for i in range(11):
        step = np.zeros(11)
        step[i] = h
        assert by_score[i] == pytest.approx((brute_likelihood(score + step, pair, first, y) - brute_likelihood(score - step, pair, first, y)) / (2 * h), abs=1e-6)
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = h
        assert by_pair[i, j] == pytest.approx((brute_likelihood(score, pair + step, first, y) - brute_likelihood(score, pair - step, first, y)) / (2 * h), abs=1e-6)


def test_training_climbs_and_learns_lines():
    """Bad documents with some good lines: training tells the lines apart, and learns that labels change from line to line."""
    rnd = np.random.default_rng(7)
    features, first, y, truth = [], [0], [], []
    for d in range(300):
        n = int(rnd.integers(3, 9))
        good = np.ones(n, dtype=int) if d % 3 else (rnd.random(n) < 0.5).astype(int)
        if not d % 3 and good.all():
            good[0] = 0
        truth += good.tolist()
        features.append(np.stack([np.where(good == 1, 1.0, -1.0) + rnd.normal(size=n), np.ones(n)], axis=1))
        first.append(first[-1] + n)
        y.append(float(d % 3 > 0))
    lines = quality_crf.Lines(np.concatenate(features), np.ones(first[-1]), np.array(first))
    y, truth = np.array(y), np.array(truth)
    w, pair = quality_crf.trained(lines, y)
    start, *_ = quality_crf.likelihood(np.zeros(first[-1]), np.zeros((2, 2)), lines.first, y)
    end, *_ = quality_crf.likelihood(lines.features @ w, pair, lines.first, y)
    assert end > start / 3
    good, *_ = quality_crf.forward_backward(lines.features @ w, pair, lines.first)
    bad_docs = np.repeat(y == 0, np.diff(lines.first))
    found = (good > 0.5)[bad_docs] == (truth == 1)[bad_docs]
    assert found.mean() > 0.7 and 0.1 < (good > 0.5)[bad_docs].mean() < 0.9


def test_score_equals_brute_force(scored):
    """Of whole documents: length-weighted mean of marginals by enumeration, then the curve."""
    import pyarrow as pa

    from plumbline.llm import textcore as tc

    docs, _, model = scored
    texts = [r.text for r in docs.limit(60).collect()]
    data, offsets = tc.buffers(pa.array(texts))
    lines = quality_crf.lines_of(data, offsets)
    score, got = lines.features @ model.weights, model.quality(lines)
    for d, (a, b) in enumerate(itertools.pairwise(lines.first.tolist())):
        if 0 < b - a <= 9:
            (*_, weights), total = next(labellings(score[a:b], model.pair, np.array([0, b - a]))), 0.0
            good = sum(np.array(path) * w for path, w in weights.items()) / sum(weights.values())
            total = float(good @ lines.length[a:b] / lines.length[a:b].sum())
            assert got[d] == pytest.approx(total, abs=1e-6)
            p = min(max(total, 1e-4), 1 - 1e-4)
            assert model.score(got[d : d + 1])[0] == pytest.approx(1 / (1 + math.exp(-(model.curve @ [math.log(p / (1 - p)), p, 1]))), abs=1e-4)


def test_long_documents_are_learned_from(spark):
    """Where one class consists of long documents only, it is known all the same."""
    rows = [(i, "\n".join(f"this is line {j} of some plain words here" for j in range(500))) for i in range(60)]
    rows += [(i, "### $$$ %%% &&&\n" * 3) for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels)
    out = quality_crf.score(docs, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id < 60) for r in out)


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, quality_crf.fit(docs, labels)


def test_held_out_accuracy(scored):
    docs, labels, model = scored
    rows = quality_crf.score(docs, model).join(labels, "doc_id").filter(labelled.held_out()).select("score", "quality").collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_learned_from(spark, scored):
    from pyspark.sql import functions as F

    docs, labels, model = scored
    other = labels.withColumn("quality", F.when(labelled.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_crf.fit(docs, other)
    assert np.allclose(again.weights, model.weights) and np.allclose(again.curve, model.curve)


def test_every_row_comes_back(docs, rows, no_docs, scored):
    *_, model = scored
    out = quality_crf.score(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.sig == "clash"
        if not (r.text or "").strip():
            assert r.score == pytest.approx(model.prior)
    assert quality_crf.score(no_docs, model).count() == 0


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_crf.fit(docs, none)
    assert {r.score for r in quality_crf.score(docs, model).select("score").distinct().collect()} == {0.5}
