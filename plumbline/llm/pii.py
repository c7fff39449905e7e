"""PII: exact patterns, and information-theoretic sanitisation of the terms that give them away.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that patterns find, and secrets: long
runs of letters and digits whose characters carry many bits each.  A mention stands for three entities: its value, its
family (an address's domain, an IP address's network, a card's issuer, a phone number's area) and its kind.  A term
discloses an entity by their pointwise mutual information in the corpus, PMI = log2(n_te * N / (n_t * n_e)), where n_te
counts the entity's mentions with the term within some words, n_t the term, n_e the mentions and N all words, against the
entity's own information IC = log2(N / n_e): PMI = IC means that the term is seen nowhere but with the entity.  A term
whose PMI is at least a share of the IC, in several different contexts and in more of them than chance would bring
about for any term of the corpus, is sanitised wherever it stands.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex
from plumbline.llm import textcore as tc

KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: Kinds of base spans, which patterns alone define; then all of protected entities.
BASE, PROTECTED = 4, 5
TERM = 5
#: Words on each side of an entity that are its context.
REACH = 8
#: Share of an entity's information that a term may not disclose, and different contexts that are needed to say so.
DISCLOSURE = 0.9
LEAST_CONTEXTS = 3
#: Bits by which the contexts of a term must be less likely than chance, beside those that pick it from all its like.
SURE_BITS = 7.0
#: Disclosing terms (8 bytes each) up to which they are broadcast; beyond, a bitmap picks and a join settles.
BROADCAST_TERMS = 1 << 20
#: A secret has so many characters, so many bits in each, and changes so often between letters and digits, at least.
SECRET_LENGTH, SECRET_BITS, SECRET_CHANGES = 20, 3.0, 4

_LOCAL = tc.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(rb"[0-9A-Za-z]{%d,}+" % SECRET_LENGTH)
_CHANGE = re.compile(rb"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_NO_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = d - 48
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and start: leftmost matches that don't overlap within a kind; those that fail a
    check are dropped.  The time is linear in the text."""
    found = []
    at, seen = text.find(b"@"), 0
    if at >= 0:
        data = np.frombuffer(text, dtype=np.uint8)
        #: Behind the last byte before each place that can't be in a local part.
        local = np.append(0, np.maximum.accumulate(np.where(_LOCAL[data], 0, np.arange(1, len(data) + 1))))
    while at >= 0:
        end = at + 1
        m = _DOMAIN.match(text, at)
        if m:
            start = max(seen, int(local[at]))
            if start < at:
                found.append((0, start, m.end()))
                seen = end = m.end()
        at = text.find(b"@", end)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip(b"0") or b"0" for p in m.group().split(b"."))):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().translate(None, _NO_DIGIT)
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(m.group().translate(None, _NO_DIGIT)) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def is_secret(run: bytes) -> bool:
    """Whether a run of letters and digits is a secret: it changes between them often, and its characters are hard to guess."""
    n = np.bincount(np.frombuffer(run, dtype=np.uint8))
    p = n[n > 0] / len(run)
    return float(-(p * np.log2(p)).sum()) >= SECRET_BITS and len(_CHANGE.findall(run)) >= SECRET_CHANGES


def _covered(spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as ascending starts and ends."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.array(sorted((a, b) for _, a, b in spans))
    ends = np.maximum.accumulate(both[:, 1])
    head = np.append(True, both[1:, 0] > ends[:-1])
    return both[head, 0], np.append(ends[:-1][head[1:]], ends[-1])


def _free(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of some byte ranges overlap none of the spans."""
    low, high = _covered(spans)
    if not len(low):
        return np.ones(len(start), dtype=bool)
    before = np.searchsorted(low, end)  # spans that begin before a range's end
    return (before == 0) | (high[np.maximum(before - 1, 0)] <= start)


def protected_spans(text: bytes) -> list[tuple[int, int, int]]:
    """Base spans, then secrets outside of them."""
    found = base_spans(text)
    runs = [m.span() for m in _RUN.finditer(text) if is_secret(m.group())]
    if runs:
        free = _free(*np.array(runs).T, found)
        found += [(4, a, b) for (a, b), f in zip(runs, free.tolist(), strict=True) if f]
    return found


def _hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def entities(kind: int, value: bytes) -> tuple[int, int, int]:
    """What a mention stands for: its kind (the number itself), its family and its value."""
    plain = value.lower() if kind == 0 else value if kind in (1, 4) else value.translate(None, _NO_DIGIT)
    family = {0: lambda: plain.rpartition(b"@")[2], 1: lambda: plain.rpartition(b".")[0], 2: lambda: plain[:6], 3: lambda: plain[:4], 4: lambda: plain}[kind]()
    return kind, _hashed(b"family", bytes([kind]), family), _hashed(b"value", bytes([kind]), plain)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with a digit or an @; no others have base spans."""
    marks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(((data >= 48) & (data <= 57)) | (data == 64), out=marks[1:])
    return np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])


def _contexts(docs: DataFrame) -> DataFrame:
    """(entity, term, context) for each term within REACH words of an entity, and a row without a term for each mention of an
    entity; context is a hash of all words around."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                words, out = None, ([], [], [])
                for d in _suspects(part, own).tolist():
                    text = part[own[d] : own[d + 1]].tobytes()
                    spans = protected_spans(text)
                    if not spans:
                        continue
                    words = tc.Words(part, own) if words is None else words
                    lo, hi = int(words.doc_first[d]), int(words.doc_first[d + 1])
                    start, end = words.starts[lo:hi] - own[d], words.ends[lo:hi] - own[d]
                    free = _free(start, end, spans)
                    h, start, end = words.hashes[lo:hi][free], start[free], end[free]
                    begins, ends = np.array([a for _, a, _ in spans]), np.array([b for *_, b in spans])
                    left, right = np.searchsorted(end, begins, side="right").tolist(), np.searchsorted(start, ends).tolist()
                    for (kind, a, b), i, j in zip(spans, left, right, strict=True):
                        around = np.append(h[max(i - REACH, 0) : i], h[j : j + REACH])
                        context = int(tc.sequence_hashes(around, np.array([0]), np.array([len(around)])).view(np.int64)[0]) if len(around) else 0
                        terms = [None, *np.unique(around).view(np.int64).tolist()]
                        for entity in entities(kind, text[a:b]):
                            out[0].extend([entity] * len(terms))
                            out[1].extend(terms)
                            out[2].extend([context] * len(terms))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["entity", "term", "context"])

    return docs.mapInArrow(run, "entity long, term long, context long")


def _term_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, n_t) over the corpus for candidates, and the count of all words as term null."""
    known = docs.sparkSession.sparkContext.broadcast(ex.bitmap(candidates, "term"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            parts, total = [np.zeros(0, dtype=np.uint64)], 0
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                h = tc.Words(data[own[0] : own[-1]], own - own[0]).hashes
                total += len(h)
                parts.append(h[known.value.may_have(h)])
            term, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*term.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), total], pa.int64())], names=["term", "n_t"])

    return docs.mapInArrow(run, "term long, n_t long").groupBy("term").agg(F.sum("n_t").alias("n_t"))


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """(term) hashes of the terms that disclose an entity, from co-occurrence over all of docs (a table with text)."""
    seen = _contexts(docs).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = ex.checkpoint(seen.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts")).filter((F.col("contexts") >= contexts) | F.col("term").isNull()))
    mentions = pairs.filter("term IS NULL").select("entity", F.col("n_te").alias("n_e"))
    pairs = pairs.filter("term IS NOT NULL")
    candidates = pairs.select("term").distinct()
    like = pairs.count()
    if not like:
        return candidates
    counts = ex.checkpoint(_term_counts(docs, candidates))
    total = float(counts.filter("term IS NULL").first()["n_t"])
    # kinds, which every frequent word stands by, are five numbers; no join has them as keys
    kinds = {r["entity"]: r["n_e"] for r in mentions.filter(F.col("entity").between(0, PROTECTED - 1)).collect()}
    of_kind = F.coalesce(*(F.when(F.col("entity") == k, F.lit(n)) for k, n in sorted(kinds.items())), F.lit(None).cast("long"))
    is_kind = F.col("entity").between(0, PROTECTED - 1)
    sized = pairs.filter(is_kind).withColumn("n_e", of_kind).unionByName(pairs.filter(~is_kind).join(mentions, "entity"))
    both = sized.join(counts.filter("term IS NOT NULL"), "term")
    pmi = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t").cast("double") * F.col("n_e")))
    own = F.log2(F.lit(total) / F.col("n_e"))
    # an occurrence of any term is near the entity with a chance of 2 * REACH * n_e / N, and there are at most 2 ^ n_t choices of the contexts among them
    bits = F.col("contexts") * (own - F.lit(float(np.log2(2 * REACH)))) - F.least("n_t", 2 * F.col("n_te"))
    return ex.checkpoint(both.filter((pmi >= disclosure * own) & (bits >= SURE_BITS + float(np.log2(like)))).select("term").distinct())


FOUND = "row_key long, doc_id long, spans array<struct<kind:int,start:long,end:long,term:long>>"


def find_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_key, doc_id, spans) of keyed rows: protected spans and disclosing terms outside of them, in code points, by kind and start."""
    n = terms.count()
    exact = n <= BROADCAST_TERMS
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(np.sort(terms.toArrow().column("term").to_numpy()) if exact else ex.bitmap(terms, "term", n))
    kind_type = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("term", pa.int64())])

    def hit(h: np.ndarray) -> np.ndarray:
        if not exact:
            return np.flatnonzero(held.value.may_have(h))
        at = np.searchsorted(held.value, h.view(np.int64))
        return np.flatnonzero(held.value[np.minimum(at, len(held.value) - 1)] == h.view(np.int64)) if len(held.value) else np.zeros(0, dtype=np.int64)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                spans: list[list] = [[] for _ in range(last - first)]
                for d in _suspects(part, own).tolist():
                    spans[d] = [(k, a, b, None) for k, a, b in protected_spans(part[own[d] : own[d + 1]].tobytes())]
                if n:
                    words = tc.Words(part, own)
                    at = hit(words.hashes)
                    of = words.doc_of()[at]
                    start, end, h = words.starts[at] - own[of], words.ends[at] - own[of], words.hashes[at].view(np.int64)
                    cuts = np.searchsorted(of, np.unique(of)).tolist()
                    for a, b in zip(cuts, [*cuts[1:], len(of)], strict=False):
                        d = int(of[a])
                        free = a + np.flatnonzero(_free(start[a:b], end[a:b], [x[:3] for x in spans[d]]))
                        spans[d] += zip([TERM] * len(free), start[free].tolist(), end[free].tolist(), h[free].tolist(), strict=True)
                for d, found in enumerate(spans):
                    if found:
                        points = tc.code_points(part[own[d] : own[d + 1]])
                        spans[d] = [{"kind": k, "start": int(points[a]), "end": int(points[b]), "term": h} for k, a, b, h in found]
                yield pa.RecordBatch.from_arrays([batch.column("row_key").slice(first, last - first), batch.column("doc_id").slice(first, last - first), pa.array(spans, pa.list_(kind_type))], names=["row_key", "doc_id", "spans"])

    found = rows.mapInArrow(run, FOUND)
    if exact:
        return found
    some = found.select("row_key", F.explode("spans").alias("s")).filter(f"s.kind = {TERM}").select("row_key", "s", F.col("s.term").alias("term")).join(terms, "term")
    settled = some.groupBy("row_key").agg(F.collect_set("s").alias("sure"))
    base = F.filter("spans", lambda s: s["kind"] < TERM)
    return found.join(settled, "row_key", "left").select("row_key", "doc_id", F.array_sort(F.concat(base, F.coalesce("sure", F.array().cast("array<struct<kind:int,start:long,end:long,term:long>>")))).alias("spans"))


def _of_kind(kind: int) -> F.Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def report(docs: DataFrame) -> DataFrame:
    """For each row its spans, counted by kind and in all (n_pii, has_pii), a digest of the base spans, and all spans as
    kind:start:end.

    A null or empty text has none.  Repeated rows each have their result.  Extra columns are ignored.
    """
    rows = ex.keyed(docs)
    found = find_spans(rows, disclosing_terms(rows))
    names = F.array(*(F.lit(k) for k in KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    counts = [F.size(_of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.size("spans").cast("long")
    return found.select("doc_id", *counts, every.alias("n_pii"), (every > 0).alias("has_pii"), F.sha2(said(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span of text generalised to its kind, as in ``<email>``; overlapping spans become one."""
    rows = ex.keyed(docs)
    key, doc, held = (ex.unused(docs.columns, n) for n in ("row_key", "doc_id", "spans"))
    found = find_spans(rows, disclosing_terms(rows)).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "row_key"]).select(F.col("row_key").alias(key), F.col("doc_id").alias(doc), F.col("spans").alias(held))
    both = docs.join(found.hint("shuffle_hash"), (ex.row_key() == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").drop(key, doc)
    columns = docs.columns

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(held).to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return both.mapInArrow(run, docs.schema)
