"""Toxicity by two class-conditional Kneser-Ney language models.

A text is its words (A-Z lower-cased), single spaces between and around them, as bytes.  Both models predict a byte from
the four before it: a class's own counts of five bytes, with an absolute discount, back off to interpolated Kneser-Ney
orders 4 to 1 that both classes share.  An expression that is rare in both classes is therefore about equally likely
under both, and bytes in place of whole words let a stem speak for words that were never seen.

A toxic document is ordinary text for the most part: word by word, its likelihood is a mixture of the ordinary model and,
at a weight of TOXIC_SHARE, the toxic one.  The score is a logistic curve over one number, the length-normalised
log-likelihood of the text as a toxic document less that as an ordinary one; the curve is fitted on a fold of labelled
documents that the counts don't have.

Every labelled document that is not held out is learned from, and every five bytes of the training text count.  Counts
are dealt by the three bytes in the middle, so a block has all that share a context, in either class or in the shared
order 4; orders 3 and below have at most 2^24 entries.  The ratios that scoring needs, one for each five bytes seen and
one for each context, are files in the folder that all executors share: they grow with the training text, and a scoring
task reads them once for GATHER_BYTES of text, or for more where they are larger than that.  The curve is fitted by sums
over all documents of its fold, which stay where they are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import exchange as ex
from plumbline.llm import labelled
from plumbline.llm import textcore as tc

#: Of the four folds that are learned from three are counted and one fits the curve.
CURVE_FOLD = 4
#: Labels up to which the table of them is broadcast; beyond, it is joined with a shuffle.
BROADCAST_LABELS = 200_000
#: Flushes of map tasks that meet at once: of more, some meet first, so a context that is everywhere comes to its block from these only.
FAN_IN = 4096
#: Documents of the curve's fold whose sums one task takes, about, and Newton steps at most.
CURVE_ROWS = 1 << 20
CURVE_STEPS = 50
#: Bytes of the longest sequence that is counted.
ORDER = 5
#: Share of a toxic document's words that the toxic model speaks.
TOXIC_SHARE = 0.01
#: Text bytes that a scoring task gathers before it reads the ratios, at least and at most: in between as many as the ratios have.
GATHER_BYTES, MOST_GATHER_BYTES = 6 << 20, 24 << 20
#: Sequences whose ratios one file has, about.
FILE_GRAMS = 1 << 21
#: A word's log-likelihood ratio counts up to this.
MOST_RATIO = 30.0
GRAM = np.dtype([("g", "<u8"), ("plain", "<u8"), ("toxic", "<u8")])
RATIO = np.dtype([("g", "<u8"), ("r", "<f4")])
#: What a block of counts is made of, and one of ratios.
GRAMS, SUMS, SUFFIXES = range(3)
SEEN, CONTEXTS = range(2)
SUFFIX = np.dtype([("s", "<u4"), ("n", "<u4")])
SPACE = np.uint8(32)


def _low(x: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of sequences."""
    return x & np.uint64((1 << (8 * n)) - 1)


class Bytes:
    """The canonical bytes of some documents: a space, then every word with a space behind it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words = tc.Words(data, offsets)
        lower = data.copy()
        upper = (lower >= 65) & (lower <= 90)
        lower[upper] += 32
        size = words.ends - words.starts
        lead = np.zeros(len(size), dtype=np.int64)
        lead[words.doc_first[:-1][words.counts > 0]] = 1
        begins = np.append(0, np.cumsum(size + lead + 1))
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.data = np.full(begins[-1], SPACE, dtype=np.uint8)
        self.data[np.repeat(begins[:-1] + lead, size) + within] = lower[np.repeat(words.starts, size) + within]
        #: Where each word begins (a document's first with the space before it), and each document; one more at the end.
        self.words, self.offsets, self.counts = begins, begins[words.doc_first], words.counts

    def grams(self, n: int = ORDER) -> np.ndarray:
        """The last n bytes at every byte as a number, zeros before a document's beginning."""
        out = np.zeros(len(self.data), dtype=np.uint64)
        place = np.arange(len(self.data)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        for j in range(min(n, max(len(out), 1))):
            byte = np.zeros(len(out), dtype=np.uint64)
            byte[j:] = self.data[: len(out) - j]
            byte[place < j] = 0
            out |= byte << np.uint64(8 * j)
        return out


class Text:
    """What scoring needs of some documents: distinct sequences, which of them stands at every byte, and where words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        text = Bytes(data, offsets)
        at, self.grams = pd.factorize(text.grams())
        self.at, self.words, self.counts = at.astype(np.int32), text.words, text.counts


def _added(h: np.ndarray, counts: dict[str, np.ndarray], dtype: np.dtype) -> np.ndarray:
    """Records of distinct sequences, ascending, with the sums of their counts."""
    own, at = np.unique(h, return_inverse=True)
    out = np.zeros(len(own), dtype)
    out[dtype.names[0]] = own
    for name, n in counts.items():
        out[name] = np.bincount(at, weights=n, minlength=len(own))
    return out


def _rows(block: int, parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int32()), pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], schema=ex.PACKED_ARROW)


def discount(once: float, twice: float) -> float:
    """Kneser and Ney's estimate from the number of sequences seen once and twice."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)) if once else 0.5


@dataclass
class Order:
    """Probabilities of a shared order: of the sequences seen, by their numbers, ascending."""

    keys: np.ndarray
    p: np.ndarray

    def of(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return self.p[at]


def shared_order(s: np.ndarray, n: np.ndarray, d: float, lower: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of distinct sequences s with continuation counts n; lower is that of their last bytes."""
    _, at = np.unique(s >> np.uint64(8), return_inverse=True)
    total, types = np.bincount(at, weights=n)[at], np.bincount(at)[at]
    return (np.maximum(n - d, 0) + d * types * lower) / total


def low_orders(s: np.ndarray, n: np.ndarray) -> Order:
    """Order 3 from its continuation counts, by way of 1 and 2."""
    levels = [(s.astype(np.uint64), n)]
    for size in (2, 1):
        levels.append(np.unique(_low(levels[-1][0], size), return_counts=True))
    below: Order | None = None
    for size, (keys, count) in zip((1, 2, 3), levels[::-1], strict=True):
        lower = np.full(len(keys), 1 / 256) if below is None else below.of(_low(keys, size - 1))
        below = Order(keys, shared_order(keys, count.astype(float), discount(np.count_nonzero(count == 1), np.count_nonzero(count == 2)), lower))
    return below


@dataclass
class Counts:
    """Where all counts are (rows of GRAMS), and what is known of all of them together."""

    grams: DataFrame | None = None
    #: Sequences seen once and twice: in ordinary, in toxic text, and continuations of order 4.
    spectrum: np.ndarray = field(default_factory=lambda: np.zeros((3, 2)))
    #: Distinct sequences.
    n: int = 0
    low: Order | None = None


def _dealt(g: np.ndarray, blocks: int) -> np.ndarray:
    return (tc.mix64(_low(g >> np.uint64(8), 3)) % np.uint64(blocks)).astype(np.int32)


def count(texts: DataFrame, total: int | None = None) -> Counts:
    """Counts of all five bytes of (text, label) rows; total is the bytes of their texts, if known."""
    total = ex.text_bytes(texts) if total is None else total
    blocks = ex.blocks_for(texts.sparkSession, total)
    ways = total // (ex.flush_bytes(blocks) * FAN_IN) + 1

    def per_chunk(batch, data, offsets, first, last):  # noqa: ANN001, ANN202
        text = Bytes(data, offsets)
        toxic = np.repeat(batch.column("label").slice(first, last - first).to_numpy(), np.diff(text.offsets))
        return _added(text.grams(), {"plain": toxic == 0, "toxic": toxic == 1}, GRAM)

    def together(got: np.ndarray) -> np.ndarray:
        return _added(got["g"], {name: got[name] for name in ("plain", "toxic")}, GRAM)

    def flush(parts: list) -> list:
        got = together(np.concatenate(parts))
        return [ex.pack(_dealt(got["g"], blocks), 0, got)]

    def some_meet(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(table.column("block")[0].as_py(), [(0, together(ex.unpack(table, 0, GRAM)))])])

    def at_block(table: pa.Table) -> pa.Table:
        got = together(ex.unpack(table, 0, GRAM))
        four, n = np.unique(_low(got["g"], 4), return_counts=True)
        three, types = np.unique(_low(four, 3), return_counts=True)
        suffixes = np.zeros(len(three), SUFFIX)
        suffixes["s"], suffixes["n"] = three, types
        spectrum = np.array([np.count_nonzero(x == k) for x in (got["plain"], got["toxic"], n) for k in (1, 2)] + [len(got)], np.int64)
        return pa.Table.from_batches([_rows(table.column("block")[0].as_py(), [(GRAMS, got), (SUMS, spectrum), (SUFFIXES, suffixes)])])

    def each(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for payload in batch.column("payload"):
                got = np.frombuffer(payload.as_buffer(), SUFFIX)
                yield pa.RecordBatch.from_arrays([pa.array(got["s"].astype(np.int64)), pa.array(got["n"].astype(np.int64))], names=["s", "n"])

    sent = texts.mapInArrow(ex.map_flushed(per_chunk, flush, blocks), ex.PACKED)
    if ways > 1:  # by the task they come from, then all
        sent = sent.withColumn("way", F.pmod(F.spark_partition_id(), F.lit(ways))).groupBy("block", "way").applyInArrow(some_meet, ex.PACKED)
    grams = ex.checkpoint(sent.groupBy("block").applyInArrow(at_block, ex.PACKED))
    sums = grams.filter(F.col("kind") == SUMS).select("payload").collect()  # 56 bytes for each block
    # three bytes have 2^24 values at most, whatever the corpus
    three = grams.filter(F.col("kind") == SUFFIXES).mapInArrow(each, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow().sort_by([("s", "ascending")])
    known = sum((np.frombuffer(bytes(r["payload"]), np.int64) for r in sums), np.zeros(7, np.int64))
    low = low_orders(three.column("s").to_numpy(), three.column("n").to_numpy()) if three.num_rows else None
    return Counts(grams.filter(F.col("kind") == GRAMS), known[:6].reshape(3, 2), int(known[6]), low)


def class_chances(got: np.ndarray, spectrum: np.ndarray, low: Order) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For the counts of whole contexts: the probability of each sequence in either class, the weight of backing off in its
    context in either class, the shared probability below, and its place among the contexts."""
    four, at4, n = np.unique(_low(got["g"], 4), return_inverse=True, return_counts=True)
    below = shared_order(four, n.astype(float), discount(*spectrum[2]), low.of(_low(four, 3)))[at4]
    _, at = np.unique(got["g"] >> np.uint64(8), return_inverse=True)
    chances, weights = [], []
    for name, seen in zip(("plain", "toxic"), spectrum, strict=False):
        d = discount(*seen)
        total, types = np.bincount(at, weights=got[name]), np.bincount(at, weights=got[name] > 0)
        weight = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        weights.append(weight)
        chances.append(np.maximum(got[name] - d, 0) / np.maximum(total, 1)[at] + weight[at] * below)
    return chances, weights, below, at


def ratios(counts: Counts) -> list[str]:
    """Files of log-likelihood ratios: of all sequences seen, and of all contexts, for any other byte behind them."""
    spark, spectrum = counts.grams.sparkSession, counts.spectrum
    held = spark.sparkContext.broadcast(counts.low)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                got = np.frombuffer(payload.as_buffer(), GRAM)
                chances, weights, _, _ = class_chances(got, spectrum, held.value)
                seen, context = np.zeros(len(got), RATIO), np.zeros(len(weights[0]), RATIO)
                seen["g"], seen["r"] = got["g"], np.log(chances[1]) - np.log(chances[0])
                context["g"], context["r"] = np.unique(got["g"] >> np.uint64(8)), np.log(weights[1]) - np.log(weights[0])
                yield _rows(block, [(SEEN, seen), (CONTEXTS, context)])

    path = f"{ex.shared_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"
    counts.grams.coalesce(counts.n // FILE_GRAMS + 1).mapInArrow(run, ex.PACKED).write.option("compression", "zstd").parquet(path)
    return sorted(spark.read.schema(ex.PACKED).parquet(path).inputFiles())


def _read(files: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, ratios) of files, one block at a time."""
    for file in files:
        place, path = pyarrow.fs.FileSystem.from_uri("file://" + file[5:] if file.startswith("file:/") and not file.startswith("file://") else file)
        with place.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(64, columns=["kind", "payload"], use_threads=False):
                for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload"), strict=True):
                    yield kind, np.frombuffer(payload.as_buffer(), RATIO)


@dataclass
class Model:
    files: list[str]
    prior: float
    #: Slope and constant.
    curve: np.ndarray
    #: Text bytes that a scoring task gathers.
    gather: int = GATHER_BYTES

    def looked_up(self, grams: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios of distinct sequences, ascending; 0 where neither class has the context."""
        context, at = np.unique(grams >> np.uint64(8), return_inverse=True)
        out, other = np.full(len(grams), np.nan, np.float32), np.zeros(len(context), np.float32)
        for kind, known in _read(self.files):
            if len(known) and len(grams):
                wanted, to = (grams, out) if kind == SEEN else (context, other)
                place = np.minimum(np.searchsorted(wanted, known["g"]), len(wanted) - 1)
                got = wanted[place] == known["g"]
                to[place[got]] = known["r"][got]
        return np.where(np.isnan(out), other[at], out).astype(float)

    def compared(self, texts: list[Text]) -> np.ndarray:
        """The length-normalised comparison of every document."""
        own = np.unique(np.concatenate([t.grams for t in texts]))
        known = self.looked_up(own)
        out = []
        for text in texts:
            sums = np.append(0, np.cumsum(known[np.searchsorted(own, text.grams)][text.at]))
            word = np.diff(sums[text.words])
            mixed = np.append(0, np.cumsum(np.log1p(TOXIC_SHARE * np.expm1(np.minimum(word, MOST_RATIO)))))
            first = np.append(0, np.cumsum(text.counts))
            out.append(np.diff(mixed[first]) / np.maximum(text.counts, 1))
        return np.concatenate(out)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.curve[0] * x + self.curve[1], -30, 30)))
        return np.where(n > 0, p, self.prior)


def _gathered(model: Model, made: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: made(batch, comparison, words of each document), the ratios being read once for many batches."""

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        x, at = model.compared([text for _, texts in held for text in texts]), 0
        for batch, texts in held:
            yield made(batch, x[at : at + batch.num_rows], np.concatenate([t.counts for t in texts]))
            at += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = tc.buffers(batch.column("text"))
            texts = []
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                texts.append(Text(data[own[0] : own[-1]], own - own[0]))
            held.append((batch, texts))
            size += int(offsets[-1])
            if size >= model.gather:
                yield from settle(held)
                held, size = [], 0
        if held:
            yield from settle(held)

    return run


def _sum(v: F.Column) -> F.Column:
    """The sum of doubles as a whole number of 2^-60, which is the same in any order of the rows."""
    return F.sum((v * float(1 << 60)).cast("decimal(28, 0)"))


def fit_curve(found: DataFrame, ridge: float = 1e-6) -> np.ndarray | None:
    """Slope and constant of a logistic curve over x for (x, label) rows, by Newton steps; None where labels are all alike.

    A step takes five sums over all rows; nothing else comes to the driver.
    """

    def sums(*values: F.Column) -> np.ndarray:
        return np.array([float(v) for v in found.agg(*map(_sum, values)).first()]) / (1 << 60)

    n, ones = found.agg(F.count("*"), F.sum("label")).first()
    if not 0 < (ones or 0) < n:
        return None
    found = found.coalesce(n // CURVE_ROWS + 1)
    x, y = F.col("x"), F.col("label")
    middle = float(sums(x)[0] / n)
    spread = math.sqrt(sums((x - middle) * (x - middle))[0] / n) + 1e-9
    z = (x - middle) / spread
    w, damp = np.zeros(2), ridge * n * np.array([1.0, 0.0])
    for _ in range(CURVE_STEPS):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(w[0]) + float(w[1])))))
        v = p * (1 - p)
        gz, g, hzz, hz, h = sums((p - y) * z, p - y, v * z * z, v * z, v)
        step = np.linalg.solve(np.array([[hzz, hz], [hz, h]]) + np.diag(damp + [1e-9, 1e-6 * ridge * n + 1e-9]), np.array([gz, g]) + damp * w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return np.array([w[0] / spread, w[1] - w[0] * middle / spread])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """A model from all labelled documents of the folds that may be learned from."""
    chosen = ex.checkpoint(labelled.training_labels(labels, column))
    stats = chosen.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    prior = float(((stats["ones"] or 0) + 1) / (stats["n"] + 2))
    plain = Model([], prior, np.array([0.0, np.log(prior / (1 - prior))]))
    if not 0 < (stats["ones"] or 0) < stats["n"]:
        return plain
    chosen = F.broadcast(chosen) if stats["n"] <= BROADCAST_LABELS else chosen.hint("shuffle_hash")
    texts = ex.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of other folds leave before the join, and their lengths are summed without the texts
    counted, curved = (texts.filter(which) for which in (~labelled.fold().isin(0, CURVE_FOLD), labelled.fold() == CURVE_FOLD))
    total = counted.select("doc_id", F.octet_length("text").alias("b")).join(chosen, "doc_id").agg(F.sum("b").alias("b")).first()["b"]
    counts = count(counted.join(chosen, "doc_id"), int(total or 0))
    if counts.low is None:
        return plain
    gather = min(MOST_GATHER_BYTES, max(GATHER_BYTES, counts.n * RATIO.itemsize))
    model = Model(ratios(counts), prior, plain.curve, gather)

    def made(batch: pa.RecordBatch, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(n, pa.int64()), pa.array(x, pa.float64())], names=["label", "n", "x"])

    curve = fit_curve(ex.checkpoint(curved.join(chosen, "doc_id").mapInArrow(_gathered(model, made), "label int, n long, x double").filter("n > 0")))
    return model if curve is None else Model(model.files, prior, curve, gather)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs, all columns, with one more: the probability that the document's label of toxicity is 1.

    All words of the whole text count, A-Z lower-cased.  Texts without words (null, empty, punctuation only) get the
    share of label 1 among the training rows, and so do all texts where the training rows have one label only.  Repeated
    rows get equal scores.  A column of this name is replaced.
    """
    docs = ex.small_batches(docs.drop(column))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def made(batch: pa.RecordBatch, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x, n), pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(_gathered(model, made), schema)
