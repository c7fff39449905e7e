"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  A line's score uses features of its own and of the lines before and after it, and the
chain has weights for each pair of neighbouring labels.  Forward-backward gives each line's marginal of being good;
a document's quality is the mean of these, weighted by line length, put on a probability scale by a logistic curve.

The labels of lines are hidden; what is known is the document's.  All lines of a good document are good, and of a bad
one at least one is bad.  Training climbs the likelihood of just that, P(all good) for good documents and 1 - P(all
good) for bad ones, so a bad document may have good lines, and how good and bad lines follow each other is learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import exchange as ex
from plumbline.llm import labelled
from plumbline.llm import textcore as tc

#: Labelled documents that the model is fitted on at most, and lines that it learns from one of them: of a longer document
#: a run of neighbouring lines, which begins where a hash of the id says.
TRAINING_DOCUMENTS = 6_000
TRAINING_LINES = 40
ROUNDS = 300
UPPER, DIGIT = tc.byte_class(bytes(range(65, 91))), tc.byte_class(bytes(range(48, 58)))
STOP = tc.byte_class(b".,;:!?'\"()-")
LETTER = tc.byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
SYMBOL = ~(LETTER | DIGIT | STOP | tc.byte_class(bytes(range(0, 33))))
OWN = 12


@dataclass
class Lines:
    features: np.ndarray
    length: np.ndarray
    #: Line index at which each document begins; one more at the end.
    first: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Features of all lines that have a word, with those of their neighbours."""
    words = tc.Words(data, offsets, tc.NON_SPACE)
    n = len(words.starts)
    if not n:
        return Lines(np.zeros((0, 3 * OWN + 3), np.float32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    at_line = np.cumsum(data == 10)[words.starts]
    of = words.doc_of()
    head = np.append(True, (at_line[1:] != at_line[:-1]) | (of[1:] != of[:-1]))
    a = np.flatnonzero(head)
    b = np.append(a[1:], n)
    start, end = words.starts[a], words.ends[b - 1]
    length = end - start

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[end] - sums[start]

    line = np.cumsum(head) - 1
    order = np.lexsort((words.hashes, line))
    new = np.append(True, (words.hashes[order][1:] != words.hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))
    distinct = np.bincount(line[order][new], minlength=len(a))
    size = b - a
    symbol_end = np.bincount(line, weights=SYMBOL[data[words.ends - 1]], minlength=len(a))
    bang = np.bincount(line, weights=data[words.ends - 1] == ord("!"), minlength=len(a))
    d = of[a]
    whole = tc.sequence_hashes(words.hashes, a, b)
    by = np.lexsort((whole, d))
    fresh = np.append(True, (whole[by][1:] != whole[by][:-1]) | (d[by][1:] != d[by][:-1]))
    group = np.cumsum(fresh) - 1
    again = np.zeros(len(a))
    again[by] = (np.bincount(group) > 1)[group]
    letters = count(LETTER)
    own = np.stack(
        [
            np.log1p(length) / 5,
            np.log1p(size) / 3,
            count(UPPER) / np.maximum(letters, 1),
            4 * count(DIGIT) / length,
            4 * count(SYMBOL) / length,
            4 * count(STOP) / length,
            symbol_end / size,
            bang / size,
            1 - distinct / size,
            length / size / 10,
            STOP[data[end - 1]],
            again,
        ],
        axis=1,
    ).astype(np.float32)
    first = np.searchsorted(d, np.arange(len(offsets)))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    opens, closes = np.append(True, d[1:] != d[:-1]), np.append(d[1:] != d[:-1], True)
    before[opens], after[closes] = 0, 0
    edge = np.stack([np.ones(len(a)), opens, closes], axis=1).astype(np.float32)
    return Lines(np.concatenate([own, before, after, edge], axis=1), length, first)


def forward_backward(score: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability that each line is good; the lines that stand behind another, and the probabilities of the labels of both
    (of the one before, of the line's own); the log of the sum over all labellings of each document.

    score is the log potential of good against bad; pair[i, j] that of label j behind label i.  All documents step
    together, the longest first, so a step costs one small array operation.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    for t in range(steps):
        at = begin[: active[t]] + t
        if t:
            before = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(before[:, 0] + pair[0, 0], before[:, 1] + pair[1, 0])
            alpha[at, 1] = np.logaddexp(before[:, 0] + pair[0, 1], before[:, 1] + pair[1, 1])
        alpha[at, 1] += score[at]
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        bad, good = beta[at + 1, 0], beta[at + 1, 1] + score[at + 1]
        beta[at, 0] = np.logaddexp(pair[0, 0] + bad, pair[0, 1] + good)
        beta[at, 1] = np.logaddexp(pair[1, 0] + bad, pair[1, 1] + good)
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    has = np.diff(first) > 0
    total = np.zeros(len(first) - 1)
    total[has] = np.logaddexp(*both[first[:-1][has]].T)
    inner = np.ones(len(score), dtype=bool)
    inner[first[:-1][has]] = False
    at = np.flatnonzero(inner)
    own = np.repeat(total, np.diff(first))[at]
    joint = np.zeros((len(at), 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            joint[:, i, j] = np.exp(alpha[at - 1, i] + pair[i, j] + beta[at, j] + (score[at] if j else 0) - own)
    return good, at, joint, total


def likelihood(score: np.ndarray, pair: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of documents' labels y, and its slopes by score and by pair."""
    good, at, joint, total = forward_backward(score, pair, first)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    all_good = np.minimum(np.bincount(of, weights=score, minlength=len(n)) + np.maximum(n - 1, 0) * pair[1, 1] - total, -1e-12)
    p = np.exp(all_good)
    # for a good document what is observed less what is expected; for a bad one the same, under the condition that not all are good
    odds = np.where(y == 1, 1.0, -p / -np.expm1(all_good))
    by_score = odds[of] * (1 - good)
    by_pair = -(odds[of[at]][:, None, None] * joint).sum(axis=0)
    by_pair[1, 1] += odds[of[at]].sum()
    value = np.where(y == 1, all_good, np.log(-np.expm1(all_good)))[n > 0].sum()
    return float(value), by_score, by_pair


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * w * np.append(np.ones(len(w) - 1), 0)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag(np.append(np.ones(len(w) - 1), 1e-6)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    curve: np.ndarray
    #: Score of a document without words: the share of label 1.
    prior: float

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of being good; NaN without lines."""
        good, *_ = forward_backward(lines.features @ self.weights, self.pair, lines.first)
        sums = np.append(0, np.cumsum(np.stack([good * lines.length, lines.length], axis=1), axis=0).reshape(-1, 2)[:, 0]), np.append(0, np.cumsum(lines.length))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.diff(sums[0][lines.first]) / np.diff(sums[1][lines.first])

    def score(self, quality: np.ndarray) -> np.ndarray:
        p = np.clip(np.nan_to_num(quality, nan=0.5), 1e-4, 1 - 1e-4)
        x = np.stack([np.log(p / (1 - p)), p, np.ones(len(p))], axis=1)
        return np.where(np.isnan(quality), self.prior, 1 / (1 + np.exp(-(x @ self.curve))))


def trained(lines: Lines, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of pairs of labels: steps of adaptive length up the likelihood, which is damped a little."""
    width = lines.features.shape[1]
    w, pair = np.zeros(width), np.zeros((2, 2))
    m = [np.zeros(width + 4), np.zeros(width + 4)]
    n = max(len(y), 1)
    for i in range(1, ROUNDS + 1):
        _, by_score, by_pair = likelihood(lines.features @ w, pair, lines.first, y)
        slope = np.append(lines.features.T @ by_score / n - 1e-3 * w, (by_pair / n - 1e-3 * pair).ravel())
        m[0], m[1] = 0.9 * m[0] + 0.1 * slope, 0.99 * m[1] + 0.01 * slope**2
        step = 0.1 * (m[0] / (1 - 0.9**i)) / (np.sqrt(m[1] / (1 - 0.99**i)) + 1e-8)
        w, pair = w + step[:width], pair + step[width:].reshape(2, 2)
    return w, pair


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """A model from at most TRAINING_DOCUMENTS labelled documents of the folds that may be learned from."""
    chosen = F.broadcast(labelled.bounded_sample(labelled.training_labels(labels, column), TRAINING_DOCUMENTS))
    sample = ex.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    width = 3 * OWN + 3

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                lines = lines_of(data[own[0] : own[-1]], own - own[0])
                ids = batch.column("doc_id").slice(first, last - first)
                spare = np.maximum(np.diff(lines.first) - TRAINING_LINES, 0)
                begin = lines.first[:-1] + (tc.mix64(ids.to_numpy().view(np.uint64)) % (spare + 1).astype(np.uint64)).astype(np.int64)
                runs = list(zip(begin.tolist(), np.minimum(begin + TRAINING_LINES, lines.first[1:]).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([ids, batch.column("label").slice(first, last - first), pa.array([lines.features[a:b].tobytes() for a, b in runs], pa.binary()), pa.array([lines.length[a:b].tobytes() for a, b in runs], pa.binary())], names=["doc_id", "label", "features", "length"])

    got = sample.mapInArrow(run, "doc_id long, label int, features binary, length binary").toArrow().sort_by([("doc_id", "ascending")])
    y = got.column("label").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    prior = float((y.sum() + 1) / (len(y) + 2))
    plain = Model(np.zeros(width), np.zeros((2, 2)), np.array([0.0, 0.0, np.log(prior / (1 - prior))]), prior)
    if len(set(y)) < 2:
        return plain
    features = [np.frombuffer(x, np.float32).reshape(-1, width) for x in got.column("features").to_pylist()]
    length = [np.frombuffer(x, np.int64) for x in got.column("length").to_pylist()]
    lines = Lines(np.concatenate(features).astype(np.float64), np.concatenate(length), np.append(0, np.cumsum([len(x) for x in length])))
    w, pair = trained(lines, y)
    model = Model(w, pair, plain.curve, prior)
    quality = model.quality(lines)
    known = ~np.isnan(quality)
    p = np.clip(quality[known], 1e-4, 1 - 1e-4)
    if len(set(y[known])) == 2:
        model.curve = fit_logistic(np.stack([np.log(p / (1 - p)), p, np.ones(len(p))], axis=1), y[known])
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs, all columns, with one more: the probability that the document's quality label is 1.

    Every line of the whole text counts.  Null, empty and blank texts have no lines and get the share of label 1 among
    the training rows.  Rows are scored one by one: repeated rows get equal scores.  A column of this name is replaced.
    """
    docs = ex.small_batches(docs.drop(column))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            out = [np.zeros(0)]
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                out.append(model.score(model.quality(lines_of(data[own[0] : own[-1]], own - own[0]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)
