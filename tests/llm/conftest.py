import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 7, n: int = 160) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, ties, empty, blank, null and long texts."""
    rnd = random.Random(seed)
    vocab = [a + b for a in ("the", "or", "un", "é", "ka", "Mo", "zi", "ör") for b in ("", "ba", "ti", "no", "re", "SU", "lo")]
    words = lambda k: [rnd.choice(vocab) for _ in range(k)]

    def text(k: int) -> str:
        out = []
        for w in words(k):
            out.append(w + rnd.choice(["", "", "", "", "", ".", ","]))
        return "".join(w + (rnd.choice(["\n", "\n\n", "  "]) if rnd.random() < 0.12 else " ") for w in out).strip()

    passages = [text(40) for _ in range(4)]
    made = []
    for i in range(n):
        kind = i % 8
        if kind == 5 and made:
            t = rnd.choice(made)[1] or ""
        elif kind == 6 and made:
            w = (rnd.choice(made)[1] or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            t = " ".join(w)
        elif kind == 7:
            t = text(rnd.randrange(1, 60)) + rnd.choice(["\n", " "]) + rnd.choice(passages) + "\n" + text(20)
        else:
            t = text(rnd.choice([1, 2, 3, 5, 30, 80, 200]))
        made.append((i, t))
    made += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, text(9000)), (n + 4, "x" * 70000), (None, made[4][1]), (None, None), made[9], made[9], (made[9][0], text(30)), (-5, made[12][1]), (n + 5, "\n".join([passages[0]] * 9)), (n + 6, "a\n" * 4000)]
    return [(d, t, "en", "src0", None if t is None else len(t)) for d, t in made]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Over several partitions, with an extra column that clashes with an operator's own names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumn("sig", F.lit("clash")).withColumn("block", F.lit(1)).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
