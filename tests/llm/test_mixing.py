import math
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import mixing


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def shapes(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    n = max(1, len(words))
    odd, distinct = len(re.findall(mixing.ODD, text)) / n, len(set(words)) / n
    first = lambda *steps: [name for ok, name in steps if ok][:1]
    return {
        *first((odd > 1, " odd 1"), (odd > 0.3, " odd 0.3"), (odd > 0.1, " odd 0.1")),
        *first((distinct < 0.1, " distinct 0.1"), (distinct < 0.3, " distinct 0.3"), (distinct < 0.5 and n > 20, " distinct 0.5")),
    }


def posterior(c, text):
    words = {w for w in re.split("[ \t\n\x0b\x0c\r]", text or "") if w}
    words |= shapes(text or "")
    total, known = list(c.log_prior), c.words
    for w in words & set(known):
        total = [a + b for a, b in zip(total, known[w], strict=True)]
    total = [c.scale * a + b for a, b in zip(total, c.shift or [0.0] * len(total), strict=True)]
    e = [math.exp(x - max(total)) for x in total]
    return [x / sum(e) for x in e]


def test_posteriors_and_totals(tables):
    docs, labels = tables
    c = mixing.fit_classifier(docs, mixing.domain_of_labels(labels))
    assert set(c.domains) <= {"q0t0", "q0t1", "q1t0", "q1t1"} and c.words
    rows = mixing.mixed(docs, labels).collect()
    assert len(rows) == docs.count()
    totals, tokens = np.zeros(len(c.domains)), 0
    for r in rows:
        p = posterior(c, r.text)
        n = len([w for w in re.split("[ \t\n\x0b\x0c\r]", r.text) if w])
        assert r.n_tokens == n and r.posterior == pytest.approx(max(p)) and r.domain == c.domains[p.index(max(p))]
        assert 0 <= r.rate <= mixing.MOST_RATE
        totals += r.rate * n * np.array(p)
        tokens += n
    want = np.array([mixing.TARGETS.get(d, 0) * tokens for d in c.domains])
    assert np.abs(totals - want).max() < 5e-3 * tokens


def test_rates_are_optimal_where_targets_are_out_of_reach(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_GAIN", 1e-9)
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 200)
    monkeypatch.setattr(mixing, "WORTH", 1.0)
    monkeypatch.setattr(mixing, "EFFECTIVE", 0.0)
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    t = rng.integers(1, 400, 60)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "n_tokens long, posterior array<double>")
    for targets in ({"a": 1.0}, {"a": 0.2, "b": 0.2, "c": 0.6}, {"a": 40.0, "b": 0.1, "c": 0.1}):
        mix = mixing.fit_rates(rows, ["a", "b", "c"], targets)
        got = mix.rates.withColumnRenamed("rate", "r").collect()
        a = np.array([[r.n_tokens * x for x in r.posterior] for r in got])
        rate, n = np.array([r.r for r in got]), np.array([r.n_tokens for r in got])
        metric = (a / n[:, None]).T @ a
        inverse = np.linalg.inv(metric + mixing.RIDGE * np.trace(metric) / 3 * np.eye(3))
        slope = (a @ inverse @ (a.T @ rate - np.array(mix.wanted))) / n
        inner = (rate > 1e-9) & (rate < mixing.MOST_RATE - 1e-9)
        assert np.abs(slope[inner]).max(initial=0) < 2e-2
        assert (slope[rate <= 1e-9] > -2e-2).all() and (slope[rate >= mixing.MOST_RATE - 1e-9] < 2e-2).all()


def test_a_target_out_of_reach_does_not_empty_the_mix(spark):
    """Nothing has much of one domain: its target is missed, and the rates stay near each other all the same."""
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.uniform(0.0001, 0.003, (3000, 2)), rng.dirichlet([20, 2], 3000)], axis=1)
    p /= p.sum(axis=1, keepdims=True)
    t = rng.integers(1, 400, len(p))
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "n_tokens long, posterior array<double>")
    mix = mixing.fit_rates(rows, ["q0t0", "q0t1", "q1t0", "q1t1"], mixing.TARGETS)
    rate = np.array([r.rate for r in mix.rates.collect()])
    assert (rate * t).sum() ** 2 / (rate**2 * t).sum() / t.sum() >= mixing.EFFECTIVE and rate.max() < 20
    want = np.array([mixing.TARGETS[d] for d in ("q0t0", "q0t1", "q1t0", "q1t1")])
    assert np.abs((rate * t) @ p / t.sum() - want).max() < 0.06


def test_nulls_repeats_and_other_columns(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.rate is not None and r.sig == "clash" for r in out)
    assert all(r.n_tokens == 0 for r in out if not (r.text or "").strip())
    plan = mixing.mixed(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_no_labels_and_no_documents(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, none).collect()
    assert len(out) == len(rows) and {(r.rate, r.domain, r.posterior) for r in out} == {(1.0, None, None)}
    assert mixing.mixed(no_docs, none).count() == 0


def test_totals_are_met_wherever_rates_can_meet_them(spark):
    """At production parameters: rates far above any cap, a hot domain, and a mix that first-order steps creep to."""
    rng = np.random.default_rng(8)
    names = ["q0t0", "q0t1", "q1t0", "q1t1"]
    hot = np.where(np.arange(4000)[:, None] % 20 == 0, rng.dirichlet([0.02, 0.02, 2, 0.05], 4000), rng.dirichlet([4, 0.3, 0.05, 0.05], 4000))
    for p in (hot, rng.dirichlet([0.05, 0.02, 3, 0.03], 4000), rng.dirichlet([0.5, 0.5, 0.5, 0.5], 4000)):
        t = rng.integers(1, 400, len(p))
        rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "n_tokens long, posterior array<double>")
        mix = mixing.fit_rates(rows, names, mixing.TARGETS)
        rate = np.array([r.rate for r in mix.rates.collect()])
        want = np.array([mixing.TARGETS[d] for d in names]) * t.sum()
        assert (rate >= 0).all() and np.abs((rate * t) @ p - want).max() < 1e-5 * t.sum()


def test_all_telling_words_are_known(spark):
    """Each domain has far more words of its own than any short list; a document with one of them is recognised by it."""
    rows = [(i, f"both own{i // 20}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 20 % 2, i // 40 % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    c = mixing.fit_classifier(docs, mixing.domain_of_labels(labels))
    assert set(c.words) == {f"own{k}" for k in range(300)} | {"both"}
    # the same words in the same document twice: rows count each
    got = c.posteriors(docs.union(docs), mixing.F.col("doc_id")).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert c.domains[r.posterior.index(max(r.posterior))] == f"q{r.key // 20 % 2}t{r.key // 40 % 2}"
        assert r.posterior == pytest.approx(posterior(c, f"both own{r.key // 20}")) if r.key % 1000 == 0 else True


def test_classifier_equals_brute_force(tables):
    """Prior, weights and scale, from the texts and labels alone."""
    docs, labels = tables
    c = mixing.fit_classifier(docs, mixing.domain_of_labels(labels))
    texts = {r.doc_id: r.text for r in docs.collect()}
    folds = {r.doc_id: r.scale for r in docs.select("doc_id", mixing.for_scale().alias("scale")).collect()}
    domain = {r.doc_id: f"q{r.quality}t{r.toxic}" for r in labels.collect() if r.doc_id in texts}
    words = {d: {w for w in re.split("[ \t\n\x0b\x0c\r]", texts[d]) if w} | shapes(texts[d]) for d in domain}
    learned = [d for d in domain if not folds[d]]
    size = Counter(domain[d] for d in learned)
    n = Counter(w for d in learned for w in words[d])
    by = Counter((w, domain[d]) for d in learned for w in words[d])
    known = {w for w in n if n[w] >= mixing.LEAST_DOCUMENTS}
    assert c.domains == sorted(size)
    everywhere = {w: (n[w] + 0.2) / (len(learned) + 0.4) for w in known}
    got = c.words
    assert set(got) == known
    for w in known:
        assert got[w] == pytest.approx([math.log((by[w, d] + mixing.SMOOTH * everywhere[w]) / (size[d] + mixing.SMOOTH) / everywhere[w]) for d in c.domains])
    assert c.log_prior == pytest.approx([math.log(size[d] / len(learned)) for d in c.domains])
    log, place = [], []
    for d in sorted(x for x in domain if folds[x] and domain[x] in size):
        log.append([sum((got[w][i] for w in words[d] & known), c.log_prior[i]) for i in range(len(c.domains))])
        place.append(c.domains.index(domain[d]))
    scale, shift = mixing.fit_scale(np.array(log), np.array(place))
    assert c.scale == pytest.approx(scale, rel=1e-6) and c.shift == pytest.approx(shift, abs=1e-6)


def test_scale_makes_probabilities():
    """Overconfident log likelihoods are brought back to the truth, and no neighbouring scale or shift fits better."""
    rng = np.random.default_rng(2)
    true = rng.normal(size=(3000, 3)) + np.array([0.5, 0, -0.5])
    p = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    domain = np.array([rng.choice(3, p=x) for x in p])
    log = 20 * (true - np.array([0.5, 0, -0.5]))
    scale, shift = mixing.fit_scale(log, domain)

    def loss(scale, shift):
        z = scale * log + np.array(shift)
        z -= z.max(axis=1, keepdims=True)
        return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(len(z)), domain].mean()

    assert scale == pytest.approx(1 / 20, rel=0.15)
    assert all(loss(scale, shift) <= loss(scale * f, shift) + 1e-4 for f in (0.8, 1.25))
    assert np.array(shift) - shift[1] == pytest.approx([0.5, 0, -0.5], abs=0.15)
