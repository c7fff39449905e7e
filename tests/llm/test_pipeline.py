from collections import Counter

import pytest

import corpus_pipeline
from plumbline.llm import jaccard_join


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage keeps, written and read again, as the driver does."""
    sf_dir = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out[""] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns(kept):
    names = list(kept)
    for n in names[:-1]:
        assert kept[n].columns == kept[""].columns
    assert {"rate", "domain", "doc_id", "text"} <= set(kept[names[-1]].columns)


def test_quality_stage(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    left = {r.doc_id for r in kept["quality classifier"].select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in left for d in good) / len(good) > 0.99
    assert sum(d in left for d in bad) / len(bad) < 0.1


def test_stages_against_their_inputs(spark, kept):
    from test_decontaminate import words
    from test_jaccard_join import brute

    rows = [tuple(r) for r in kept["line dedup"].select("doc_id", "text").collect()]
    want = {k[2] for k in brute(rows, 5, 80)}
    got = Counter(r.doc_id for r in kept["n-gram Jaccard join"].collect())
    assert got == Counter(want)
    windows = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = set()
    for r in kept["n-gram Jaccard join"].collect():
        w = words(r.text)
        if not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in kept["benchmark decontamination"].collect()} == clean
    assert all(r.n_chars == len(r.text) for r in kept["benchmark decontamination"].collect())


def test_run_gives_the_same(spark, kept):
    last = list(kept)[-1]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in kept[last].collect())


def test_every_stage_takes_odd_rows(spark, docs, rows, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() <= len(rows)
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0


def test_one_of_each_keeps_one(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "u v w x y z"), (None, "u v w x y z"), (3, "one two three four five six"), (3, "one two three four five six"), (2, "one two three four five six"), (7, ""), (7, ""), (8, None)]
    got = Counter(tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([rows[0], rows[2], (2, rows[6][1]), (7, ""), (7, ""), (8, None)])
