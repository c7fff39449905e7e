import zlib

from plumbline.llm import labelled


def test_training_labels(spark):
    rows = [(i, 1, i % 2) for i in range(50)] + [(3, 1, 1), (4, None, None), (None, 1, 1), (5, 1, 7)]
    got = {r.doc_id: (r.label, r.fold) for r in labelled.training_labels(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), "toxic").collect()}
    folds = {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}
    assert got == {i: (max(i % 2, int(i == 3)), f) for i, f in folds.items() if f}


def test_bounded_sample(spark):
    rows = spark.range(20000).withColumnRenamed("id", "doc_id")
    assert labelled.bounded_sample(rows, 20000).count() == 20000
    some = labelled.bounded_sample(rows, 2000)
    assert 1700 < some.count() <= 2000
    assert some.exceptAll(labelled.bounded_sample(rows.repartition(7), 2000)).count() == 0
