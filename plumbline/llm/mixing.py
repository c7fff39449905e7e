"""Mixing sources to target weights, with soft membership.

A naive Bayes classifier learned from a table of labelled documents gives every document a posterior over domains.  Words
of a text are no independent witnesses, so its log likelihoods are scaled and shifted by what fits a part of the
labelled documents that it was not learned from: posteriors are probabilities, and their sums expected tokens.
Nonnegative document rates are then fitted so that the expected tokens of each domain, sum of rate * tokens *
posterior, meet target totals: generalised least squares, by Newton steps on one multiplier for each domain.  Every
step is one aggregate over all documents; only sums by domain reach the driver.  Only DataFrame functions are used.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex
from plumbline.llm.labelled import bounded_sample

#: Labelled documents that the classifier is fitted on at most, of which one in so many is for the scale; and documents that a
#: word must be in to be known.
TRAINING_DOCUMENTS = 10_000
SCALE_SHARE = 5
LEAST_DOCUMENTS = 5
#: Documents' worth of a word's frequency everywhere that its frequency in each domain is smoothed with: a rare word says little.
SMOOTH = 500.0
#: Known words that are broadcast at most; more are joined with a shuffle.
BROADCAST_WORDS = 100_000
#: Share of each domain (q: quality, t: toxicity, as labelled) in the mix; domains not named get none.
TARGETS = {"q1t0": 0.90, "q1t1": 0.04, "q0t0": 0.05, "q0t1": 0.01}
#: An upper bound of rates for those who want one; by default rates are bounded below only.
MOST_RATE = math.inf
#: The fit ends when every domain's total is this close (as a share of all tokens) to its target, or to the best that can be reached
#: where the target can't.  A round in which the objective falls by no more than this share is at the limit of the arithmetic.
TOLERANCE, LEAST_GAIN, MOST_ROUNDS = 1e-6, 1e-14, 200
#: Share of an even metric in that of the errors: without, a direction in which documents hardly differ would outweigh all others.
RIDGE = 0.1
#: Where targets can't be met, the evenest rates are taken whose largest error is at most so many times the least, among rates that
#: leave at least this share of the tokens in effect (the square of the rates' sum to the sum of squares): a handful is no mix.
WORTH, EFFECTIVE = 1.25, 0.25
#: Share of all tokens by which a total must differ for its target to be out of reach.
MISSED = 1e-3
#: Weight of the distance from even rates beside the totals' errors: it picks among rates that do equally well.
EVEN = 1e-8
#: Marks that prose seldom has, and capitals in a row.
ODD = r"[#$%&*+/<=>@\\^_`{|}~\[\]]|[A-Z]{2}"


def with_words(docs: DataFrame, *keep: Column) -> DataFrame:
    """(*keep, words, n_tokens, shapes): the distinct strings between ASCII white space, case and marks included, how many there
    are with repeats, and marks of the text's make-up: how odd its characters are and how often it repeats itself."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = F.col("__text")
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    # no regular expression here: a split at one plain character is several times as fast
    df = ex.once(docs.select(*keep, text.alias("__text")), "words", F.array_remove(F.split(F.replace(spaced, F.lit("  "), F.lit(" ")), " "), ""))
    df = df.withColumn("n_tokens", F.size("words").cast("long"))
    n = F.greatest(F.size("words"), F.lit(1)).cast("double")
    df = ex.once(ex.once(df, "__odd", F.regexp_count("__text", F.lit(ODD)) / n), "__distinct", F.array_distinct("words"))
    odd, distinct = F.col("__odd"), F.size("__distinct") / n
    shapes = F.array(
        F.when(odd > 1, " odd 1").when(odd > 0.3, " odd 0.3").when(odd > 0.1, " odd 0.1"),
        F.when(distinct < 0.1, " distinct 0.1").when(distinct < 0.3, " distinct 0.3").when((distinct < 0.5) & (n > 20), " distinct 0.5"),
    )
    return df.select(*(c for c in df.columns if c not in ("words", "__text", "__odd", "__distinct")), F.col("__distinct").alias("words"), F.array_compact(shapes).alias("shapes"))


@dataclass
class Classifier:
    domains: list[str]
    #: Log share of each domain.
    log_prior: list[float]
    #: (word, w_0, w_1, ...): what a word's presence adds in each domain, the log of its frequency there to that everywhere; written down.
    table: DataFrame | None = field(default=None, repr=False)
    n_words: int = 0
    #: Log likelihoods times scale plus shift are the logs of posteriors, but for a constant.
    scale: float = 1.0
    shift: tuple[float, ...] = ()

    @property
    def words(self) -> dict[str, list[float]]:
        """The table as a dictionary: for looking at it."""
        return {r[0]: list(r[1:]) for r in self.table.toLocalIterator()} if self.n_words else {}

    def logs(self, docs: DataFrame, key: Column) -> DataFrame:
        """(key, n_tokens, log) of every row of docs: log likelihoods of the domains, from the distinct known words and the shapes."""
        n = len(self.domains)
        words = with_words(docs, key.alias("key"), F.monotonically_increasing_id().alias("__row"))
        if not self.n_words:
            return words.select("key", "n_tokens", F.array(*(F.lit(x) for x in self.log_prior)).cast("array<double>").alias("log"))
        # no word is empty: the prior stands for that, so a row without known words has a match too
        prior = self.table.sparkSession.createDataFrame([("", *self.log_prior)], self.table.schema)
        known = self.table.unionByName(prior)
        each = words.select("key", "__row", "n_tokens", F.explode(F.concat("words", "shapes", F.array(F.lit("")))).alias("word"))
        df = each.join(F.broadcast(known) if self.n_words <= BROADCAST_WORDS else known, "word")
        df = df.groupBy("key", "__row", "n_tokens").agg(*(F.sum(f"w_{d}").alias(f"w_{d}") for d in range(n)))
        return df.select("key", "n_tokens", F.array(*(f"w_{d}" for d in range(n))).alias("log"))

    def posteriors(self, docs: DataFrame, key: Column) -> DataFrame:
        """(key, n_tokens, posterior) of every row of docs: an array<double> over the domains."""
        shift = F.array(*(F.lit(float(x)) for x in (self.shift or [0.0] * len(self.domains)))).cast("array<double>")
        df = self.logs(docs, key).withColumn("__log", F.zip_with("log", shift, lambda x, b: x * F.lit(self.scale) + b))
        df = ex.once(df.select("key", "n_tokens", "__log"), "__top", F.array_max("__log"))
        df = ex.once(df, "__scaled", F.transform("__log", lambda x: F.exp(x - F.col("__top"))))
        df = ex.once(df, "__sum", F.aggregate("__scaled", F.lit(0.0), lambda a, b: a + b))
        return df.select("key", "n_tokens", F.transform("__scaled", lambda x: x / F.col("__sum")).alias("posterior"))


def fit_scale(log: np.ndarray, domain: np.ndarray, rounds: int = 50) -> tuple[float, tuple[float, ...]]:
    """The scale and shifts under which softmax(scale * log + shift) fits domains best: a convex problem of few numbers, by Newton steps."""
    n, k = log.shape
    spread = max(float(log.std()), 1e-9)
    log = (log - log.max(axis=1, keepdims=True)) / spread
    theta, ridge = np.zeros(k + 1), 1e-3 * n
    for _ in range(rounds):
        z = theta[0] * log + theta[1:]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = p - (np.arange(k) == domain[:, None])
        mean = (p * log).sum(axis=1)
        slope = np.append((off * log).sum(), off.sum(axis=0)) + ridge * theta
        cross = (p * (log - mean[:, None])).sum(axis=0)
        second = np.zeros((k + 1, k + 1))
        second[0, 0] = (p * log**2).sum() - (mean**2).sum()
        second[0, 1:] = second[1:, 0] = cross
        second[1:, 1:] = np.diag(p.sum(axis=0)) - p.T @ p
        step = np.linalg.solve(second + ridge * np.eye(k + 1), slope)
        theta -= step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]) / spread, 0.0), tuple(theta[1:].tolist())


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels with both marks, one row for each id (its largest domain)."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))).alias("domain"))


def for_scale() -> Column:
    """Whether a labelled document is one that fits the scale."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(SCALE_SHARE)) == 0


def fit_classifier(docs: DataFrame, domains: DataFrame) -> Classifier:
    """From at most TRAINING_DOCUMENTS of (doc_id, domain): smoothed presence in each domain of all words of LEAST_DOCUMENTS
    documents, and the scale of what they say together."""
    chosen = ex.checkpoint(bounded_sample(domains, TRAINING_DOCUMENTS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    learned = texts.filter(~for_scale())
    sample = with_words(learned, F.col("domain")).select("domain", F.concat("words", "shapes").alias("words"))
    sizes = {r["domain"]: r["n"] for r in learned.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()}
    names, total = list(sizes), sum(sizes.values())
    if not names:
        return Classifier([], [])
    seen = sample.select("domain", F.explode("words").alias("word")).filter("word <> ''")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(names)))
    everywhere = (F.col("n") + 0.2) / F.lit(total + 0.4)
    there = [(F.col(f"n_{i}") + F.lit(SMOOTH) * everywhere) / F.lit(sizes[d] + SMOOTH) for i, d in enumerate(names)]
    weights = [F.log(x / everywhere).alias(f"w_{i}") for i, x in enumerate(there)]
    table = ex.checkpoint(counts.filter(F.col("n") >= LEAST_DOCUMENTS).select("word", *weights))
    made = Classifier(names, [float(np.log(sizes[d] / total)) for d in names], table, table.count())
    place = F.array_position(F.array(*(F.lit(d) for d in names)), F.col("domain")) - 1
    fold = texts.filter(for_scale()).select("text", F.struct("doc_id", place.alias("place")).alias("fold"))
    # a number for each domain of a fifth of TRAINING_DOCUMENTS rows
    got = [(r["key"]["doc_id"], r["key"]["place"], r["log"]) for r in made.logs(fold, F.col("fold")).collect() if r["key"]["place"] >= 0]
    got.sort()
    if len({place for _, place, _ in got}) > 1:
        made.scale, made.shift = fit_scale(np.array([log for *_, log in got]), np.array([place for _, place, _ in got]))
    return made


@dataclass
class Mix:
    #: (key, n_tokens, posterior, rate) of every row.
    rates: DataFrame
    reached: list[float]
    wanted: list[float]


def _rate(even: float, posterior: Column, y: np.ndarray) -> tuple[Column, Column]:
    """An even rate moved along the domains' multipliers, as it is and put between its bounds."""
    free = sum((F.get(posterior, F.lit(d)) * F.lit(float(x)) for d, x in enumerate(y)), F.lit(even))
    rate = F.greatest(F.lit(0.0), free)
    return free, rate if math.isinf(MOST_RATE) else F.least(F.lit(MOST_RATE), rate)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None) -> Mix:
    """Nonnegative rates for (key, n_tokens, posterior) rows whose domain totals meet targets * budget (default: all tokens).

    The objective is res' M^-1 res with res the domain totals' errors and M = sum of tokens * posterior posterior' + RIDGE, and EVEN
    times the rates' distance from an even one.  Its dual has one multiplier for each domain, y: rates are even + posterior' y cut
    off at 0, and y is where res + EVEN * M y = 0.  That is the slope of a convex, piecewise quadratic function, so Newton
    steps, shortened where they overshoot, end at it.
    """
    n = len(domains)
    p = [F.get("posterior", F.lit(d)) for d in range(n)]
    t = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    first = members.agg(F.sum(t).alias("t"), *(F.sum(t * p[i] * p[j]).alias(f"m_{i}_{j}") for i, j in pairs)).first()
    total = float(first["t"] or 0.0)
    if not n or not total:
        return Mix(members.withColumn("rate", F.lit(1.0)), [], [])
    square = lambda row: np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    m = square(first)
    m = m + RIDGE * np.trace(m) / n * np.eye(n)
    budget = total if budget is None else budget
    wanted = np.array([targets.get(d, 0.0) * budget for d in domains])
    even = min(budget / total, MOST_RATE)

    def energy(free: Column, rate: Column) -> Column:
        return F.sum(t * rate * (free - rate / 2))

    def value(y: np.ndarray, e: float, weight: float) -> float:
        return e - float(wanted @ y) + weight / 2 * float(y @ m @ y)

    def at(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        free, rate = _rate(even, F.col("posterior"), y)
        inner = F.when((free > 0) & (free < F.lit(MOST_RATE)), t).otherwise(0.0)
        row = members.agg(energy(free, rate).alias("e"), *(F.sum(t * rate * p[d]).alias(f"s_{d}") for d in range(n)), *(F.sum(inner * p[i] * p[j]).alias(f"m_{i}_{j}") for i, j in pairs)).first()
        return float(row["e"]), np.array([row[f"s_{d}"] for d in range(n)]), square(row)

    def shorter(y: np.ndarray, step: np.ndarray, weight: float) -> int:
        """Which of many lengths of a step is best, in one pass."""
        tried = [y + step * 0.5**k for k in range(1, 25)]
        row = members.agg(*(energy(*_rate(even, F.col("posterior"), x)).alias(f"e_{k}") for k, x in enumerate(tried))).first()
        return min(((value(x, row[f"e_{k}"], weight), k) for k, x in enumerate(tried)))[1]

    y, rounds = np.zeros(n), 0
    e, reached, inner = at(y)
    levels: list[tuple[float, np.ndarray, np.ndarray, float]] = []
    # the even rates' weight falls step by step, so that every fit begins near its end
    for weight in (1.0, 0.1, 1e-2, 1e-4, 1e-6, EVEN):
        while rounds < MOST_ROUNDS:
            slope = reached - wanted + weight * (m @ y)
            if np.abs(slope).max() <= TOLERANCE / 10 * budget:
                break
            rounds += 1
            step = -np.linalg.pinv(inner + weight * m, rcond=1e-13, hermitian=True) @ slope
            before = value(y, e, weight)
            to = y + step
            found = at(to)
            if value(to, found[0], weight) > before + 1e-4 * float(slope @ step):
                to = y + step * 0.5 ** (shorter(y, step, weight) + 1)
                found = at(to)
            gain = before - value(to, found[0], weight)
            if gain <= 0:
                break
            y, (e, reached, inner) = to, found
            if gain <= LEAST_GAIN * abs(before):
                break
        error = float(np.abs(reached - wanted).max())
        r = _rate(even, F.col("posterior"), y)[1]
        size = members.agg((F.sum(t * r) * F.sum(t * r) / F.sum(t * r * r)).alias("k")).first()["k"] or 0.0
        levels.append((error, y, reached, size / total))
        if error <= TOLERANCE * budget:
            break
    if levels[-1][0] > MISSED * budget:  # a target is out of reach: rates shall not part company for next to nothing
        some = [x for x in levels if x[3] >= EFFECTIVE] or levels[:1]
        least = min(error for error, *_ in some)
        _, y, reached, _ = next(x for x in some if x[0] <= WORTH * least)
    if np.abs(reached - wanted).max() > TOLERANCE * budget:
        logging.getLogger(__name__).warning("domain totals %s for targets %s after %d rounds", dict(zip(domains, reached / budget, strict=True)), dict(zip(domains, wanted / budget, strict=True)), rounds)
    return Mix(members.withColumn("rate", _rate(even, F.col("posterior"), y)[1]), reached.tolist(), wanted.tolist())


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """docs, all columns, with n_tokens, domain (the likeliest), posterior (its probability) and rate.

    Posteriors come from the words of the whole text.  Null, empty and blank texts have no tokens: their posterior is the
    prior's and their rate follows it, without effect on any total.  Without labels, domain and posterior are null and
    every rate is 1.  Repeated rows count, and are rated, each.  Columns of these names in docs are replaced.
    """
    docs = docs.drop("n_tokens", "domain", "posterior", "rate")
    classifier = fit_classifier(docs, domain_of_labels(labels))
    key = F.struct(F.col("doc_id").cast("long").alias("id"), ex.row_key().alias("h"))
    members = ex.checkpoint(classifier.posteriors(docs, key))
    mix = fit_rates(members, classifier.domains, TARGETS if targets is None else targets, budget)
    top = F.array_max("posterior")
    names = F.array(*(F.lit(d) for d in classifier.domains)).cast("array<string>")
    rated = mix.rates.select(F.col("key").alias("__key"), "n_tokens", F.get(names, (F.array_position("posterior", top) - 1).cast("int")).alias("domain"), top.alias("likeliest"), F.round("rate", 9).alias("rate"))
    rated = rated.dropDuplicates(["__key"]).withColumnRenamed("likeliest", "posterior")
    name = ex.unused(docs.columns, "key")
    return docs.withColumn(name, key).join(rated.withColumnRenamed("__key", name).hint("shuffle_hash"), name, "left").drop(name)
