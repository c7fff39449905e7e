import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import labelled, toxicity_kn
from plumbline.llm import textcore as tc
from plumbline.llm.quality_crf import fit_logistic


def made(n=900, seed=5):
    """Documents of ordinary words; toxic ones have a few expressions that ordinary ones lack."""
    rnd = random.Random(seed)
    vocab = [a + b + c for a in ("th", "er", "on") for b in ("a", "e", "in", "ou") for c in ("", "t", "nd", "ly", "re")]
    docs, labels = [], []
    for i in range(n):
        words, toxic = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 200))], int(i % 4 == 0)
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["grubby", "Vile,", "nastiest"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = made()
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, toxicity_kn.fit(docs, labels)


def canonical(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, (" " + " ".join(words) + " ").encode() if words else b""


class Brute:
    """The two models in dictionaries, from the definition."""

    def __init__(self, rows):
        self.top = [Counter(), Counter()]
        for text, label in rows:
            _, b = canonical(text)
            b = bytes(4) + b
            for i in range(4, len(b)):
                self.top[label][b[i - 4 : i + 1]] += 1
        self.order = {5: set(self.top[0]) | set(self.top[1])}
        for k in (4, 3, 2, 1):
            self.order[k] = {g[1:] for g in self.order[k + 1]}
        self.n = {k: Counter(g[1:] for g in self.order[k + 1]) for k in (1, 2, 3, 4)}
        self.d = {k: self.discount(n) for k, n in self.n.items()}
        self.dc = [self.discount(n) for n in self.top]
        self.sums = {k: self.totals(n) for k, n in self.n.items()}
        self.class_sums = [self.totals(n) for n in self.top]

    @staticmethod
    def discount(n):
        a, b = (sum(x == k for x in n.values()) for k in (1, 2))
        return min(max(a / max(a + 2 * b, 1), 0.1), 0.9) if a else 0.5

    @staticmethod
    def totals(n):
        out = defaultdict(lambda: [0, 0])
        for g, x in n.items():
            out[g[:-1]][0] += x
            out[g[:-1]][1] += 1
        return out

    def shared(self, g):
        k = len(g)
        lower = self.shared(g[1:]) if k > 1 else 1 / 256
        total, types = self.sums[k].get(g[:-1], (0, 0))
        return (max(self.n[k][g] - self.d[k], 0) + self.d[k] * types * lower) / total if total else lower

    def chance(self, c, g):
        total, types = self.class_sums[c].get(g[:-1], (0, 0))
        lower = self.shared(g[1:])
        return (max(self.top[c][g] - self.dc[c], 0) + self.dc[c] * types * lower) / total if total else lower

    def compared(self, text):
        words, b = canonical(text)
        b, total, at = bytes(4) + b, 0.0, 4
        for i, w in enumerate(words):
            end = at + (i == 0) + len(w.encode()) + 1
            r = sum(math.log(self.chance(1, b[j - 4 : j + 1])) - math.log(self.chance(0, b[j - 4 : j + 1])) for j in range(at, end))
            total += math.log(1 - toxicity_kn.TOXIC_SHARE + toxicity_kn.TOXIC_SHARE * math.exp(r))
            at = end
        return total / max(len(words), 1)


@pytest.fixture(scope="module")
def brute(fitted):
    docs, labels, _ = fitted
    used = labelled.training_labels(labels, "toxic").filter(F.col("fold") != toxicity_kn.CURVE_FOLD).join(docs, "doc_id").collect()
    return Brute([(r.text, r.label) for r in used])


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    rows = toxicity_kn.score(docs, model).join(labels, "doc_id").filter(labelled.held_out()).select("score", "toxic").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) / len(rows) > 0.97


def test_every_sequence_counts(fitted, brute):
    docs, labels, _ = fitted
    used = labelled.training_labels(labels, "toxic").filter(F.col("fold") != toxicity_kn.CURVE_FOLD).join(docs, "doc_id")
    counts = toxicity_kn.count(used)
    got = np.concatenate([np.frombuffer(bytes(r.payload), toxicity_kn.GRAM) for r in counts.grams.collect()])
    want = {int.from_bytes(g, "big"): (brute.top[0][g], brute.top[1][g]) for g in brute.order[5]}
    assert {int(x["g"]): (int(x["plain"]), int(x["toxic"])) for x in got} == want
    assert len(got) == len(want)


def test_probabilities_sum_to_one(fitted, brute):
    """Of all 256 bytes behind each context, in each class and in the shared orders."""
    rnd = random.Random(1)
    contexts = [*rnd.sample(sorted({g[:-1] for g in brute.order[5]}), 60), b"zzzz", b"\xff\x00 x"]
    for c in (0, 1):
        for v in contexts:
            assert sum(brute.chance(c, v + bytes([b])) for b in range(256)) == pytest.approx(1)
    docs, labels, _ = fitted
    used = labelled.training_labels(labels, "toxic").filter(F.col("fold") != toxicity_kn.CURVE_FOLD).join(docs, "doc_id")
    counts = toxicity_kn.count(used)
    for r in counts.grams.collect():
        got = np.frombuffer(bytes(r.payload), toxicity_kn.GRAM)
        chances, weights, below, at = toxicity_kn.class_chances(got, counts.spectrum, counts.low)
        for c in (0, 1):  # bytes never seen behind a context have its weight times the shared probability that is left
            total = np.bincount(at, weights=chances[c]) + weights[c] * (1 - np.bincount(at, weights=below))
            assert np.allclose(total, 1)
        for c in (0, 1):
            want = [brute.chance(c, int(g).to_bytes(5, "big")) for g in got["g"][:50]]
            assert chances[c][:50] == pytest.approx(want)


def test_comparison_and_score_equal_brute_force(fitted, brute):
    docs, _, model = fitted
    texts = ["The vile grubby unheard-of nastiest " + docs.first().text, "x", "Ünïcode Wörter — vile!", "", docs.first().text, "1 2 3 grubbygrubby"]
    data, offsets = tc.buffers(pa.array(texts))
    want = [brute.compared(t) for t in texts]
    got = model.compared([toxicity_kn.Text(data, offsets)])
    assert got == pytest.approx(want, abs=1e-6)
    scored = {r.doc_id: r.score for r in toxicity_kn.score(docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        p = 1 / (1 + math.exp(-(model.curve[0] * want[i] + model.curve[1]))) if t else model.prior
        assert scored[i] == pytest.approx(p, abs=1e-4)


def test_held_out_labels_are_not_learned_from(fitted):
    docs, labels, model = fitted
    other = labels.withColumn("toxic", F.when(labelled.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity_kn.fit(docs, other)
    data, offsets = tc.buffers(pa.array([r.text for r in docs.limit(20).collect()]))
    text = toxicity_kn.Text(data, offsets)
    assert np.allclose(again.curve, model.curve) and np.array_equal(again.compared([text]), model.compared([text]))


def test_every_row_comes_back(docs, rows, no_docs, fitted):
    *_, model = fitted
    out = toxicity_kn.score(docs, model).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 for r in out)
    assert {round(r.score, 9) for r in out if not (r.text or "").strip()} == {round(model.prior, 9)}
    assert toxicity_kn.score(no_docs, model).count() == 0


def test_no_labels_and_one_label(spark, docs):
    model = toxicity_kn.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity_kn.score(docs, model).select("score").distinct().collect()} == {0.5}
    model = toxicity_kn.fit(docs, docs.selectExpr("doc_id", "0 AS toxic"))
    assert all(r.score == pytest.approx(model.prior) for r in toxicity_kn.score(docs, model).collect())


def test_all_labelled_documents_are_learned_from(spark, monkeypatch):
    """However many there are: 208,000 here."""
    docs = spark.range(260_000).selectExpr("id AS doc_id", "concat('w', id % 97) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 5 = 0) AS toxic")
    seen, count = [], toxicity_kn.count
    monkeypatch.setattr(toxicity_kn, "count", lambda texts, *rest: seen.append(texts.count()) or count(texts, *rest))
    model = toxicity_kn.fit(docs, labels)
    used = labelled.training_labels(labels, "toxic")
    assert seen == [used.filter(F.col("fold") != toxicity_kn.CURVE_FOLD).count()]
    assert model.prior == (used.filter("label = 1").count() + 1) / (used.count() + 2)


def test_joined_labels_give_the_same_model(fitted, monkeypatch):
    docs, labels, model = fitted
    monkeypatch.setattr(toxicity_kn, "BROADCAST_LABELS", 0)
    again = toxicity_kn.fit(docs, labels)
    data, offsets = tc.buffers(pa.array([r.text for r in docs.limit(20).collect()]))
    text = toxicity_kn.Text(data, offsets)
    assert np.allclose(again.curve, model.curve) and np.array_equal(again.compared([text]), model.compared([text]))


def test_counts_that_meet_in_two_steps(fitted, brute):
    docs, labels, _ = fitted
    used = labelled.training_labels(labels, "toxic").filter(F.col("fold") != toxicity_kn.CURVE_FOLD).join(docs, "doc_id").repartition(6)
    counts = toxicity_kn.count(used, 10**11)  # as if there were so many bytes
    got = np.concatenate([np.frombuffer(bytes(r.payload), toxicity_kn.GRAM) for r in counts.grams.collect()])
    want = {int.from_bytes(g, "big"): (brute.top[0][g], brute.top[1][g]) for g in brute.order[5]}
    assert {int(x["g"]): (int(x["plain"]), int(x["toxic"])) for x in got} == want
    assert len(got) == len(want)


def test_counts_beyond_32_bits():
    many = np.array([3 << 30, 3 << 30], np.uint64)
    got = toxicity_kn._added(np.array([7, 7], np.uint64), {"plain": many, "toxic": many}, toxicity_kn.GRAM)
    assert got["plain"].tolist() == got["toxic"].tolist() == [6 << 30]


def test_curve_equals_that_of_all_rows_at_once(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(0.02, 0.003, 3000)
    y = (rnd.random(3000) < 1 / (1 + np.exp(-900 * (x - 0.021)))).astype(int)
    found = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, label int")
    z = (x - x.mean()) / (x.std() + 1e-9)
    slope, constant = fit_logistic(np.stack([z, np.ones(len(z))], axis=1), y, ridge=1e-6)
    want = [slope / (x.std() + 1e-9), constant - slope * x.mean() / (x.std() + 1e-9)]
    assert toxicity_kn.fit_curve(found) == pytest.approx(want, rel=1e-6)
    assert toxicity_kn.fit_curve(found.filter("label = 1")) is None
