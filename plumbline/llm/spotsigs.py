"""Document fingerprints by SpotSigs.

A spot signature is a common word (the anchor) with the chain of the two content words behind it; common words are
passed over.  Signatures sit in running text and pass over lists and boilerplate without common words.  The set of a
text's signatures is its fingerprint; likeness is Jaccard's, and sets are partitioned by length so that only sets
with sizes that allow the wanted likeness are compared.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex
from plumbline.llm import jaccard_join
from plumbline.llm import textcore as tc

# Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = """
a an and are as at be but by can do for from had has have he her his i if in is it not of on or our she so that the
their them there they this to was we were which will with you your
als am auch auf aus bei das dem den der des die durch ein eine einem einen einer es für im ist mit nach nicht noch
oder sich sie sind so über um und von vor war wie wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus
pour qui que sa se ses son sont sur un une vous
al como con de del el ella en era es esta este fue ha la las lo los más me no para pero por que se ser sin sobre su
sus también un una y ya
""".split()
CHAIN = 2
#: Rows whose texts one sorted run of neighbours has, about, and runs that a task has.
RUN_ROWS, TASK_RUNS = 1_000, 4
#: Most runs, but for those that one id with very many rows is cut into; with more rows than RUN_ROWS times this, runs become longer.
MOST_RUNS = 1 << 17
#: A null id comes behind all others.
LOWEST = -(1 << 63)
#: Kinds of rows in a run: what is noted of its documents, the documents, and the one behind them.
NOTE, OWN, BORDER = range(3)


def _anchor_hashes() -> np.ndarray:
    data, offsets = tc.buffers(pa.array(sorted(set(ANCHORS))))
    return np.sort(tc.Words(data, offsets).hashes)


_ANCHORS = _anchor_hashes()


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signature hashes of every document, ascending, and n + 1 offsets.

    A text without anchors has the chains of all its words; one without words, but not empty, a hash of its bytes.
    """
    words = tc.Words(data, offsets)
    h, of, n = words.hashes, words.doc_of(), len(words.hashes)
    place = np.searchsorted(_ANCHORS, h)
    anchor = _ANCHORS[np.minimum(place, len(_ANCHORS) - 1)] == h
    content = np.flatnonzero(~anchor)
    heads = np.flatnonzero(anchor)
    after = np.searchsorted(content, heads)
    padded, docs = np.append(content, [n] * CHAIN), np.append(of, -1)
    hashes = np.append(h, np.uint64(0))
    with np.errstate(over="ignore"):
        value = h[heads] * tc.PLACE[0]
        first = docs[padded[after]] == of[heads]
        for j in range(CHAIN):
            at = padded[after + j]
            inside = docs[at] == of[heads]
            value = value + np.where(inside, hashes[at] * tc.PLACE[j + 1], 0).astype(np.uint64)
        value, owner = tc.mix64(value)[first], of[heads][first]
        bare = np.setdiff1d(np.flatnonzero(words.counts > 0), owner)
        if len(bare):
            at = np.flatnonzero(np.isin(of, bare))
            plain = h[at] * tc.PLACE[0]
            for j in range(1, CHAIN + 1):
                to = np.minimum(at + j, n)
                plain = plain + np.where(docs[to] == of[at], hashes[to] * tc.PLACE[j], 0).astype(np.uint64)
            value, owner = np.append(value, tc.mix64(plain)), np.append(owner, of[at])
    wordless = np.flatnonzero((words.counts == 0) & (np.diff(offsets) > 0))
    value, owner = np.append(value, tc.range_hashes(data, offsets[wordless], offsets[wordless + 1])), np.append(owner, wordless)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        keep = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
        value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(offsets)))


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The signature sets of texts, as 32-bit hashes, ascending."""
    out = []
    data, offsets = tc.buffers(pa.array(texts, pa.large_string()))
    for first, last in tc.chunks(offsets):
        own = offsets[first : last + 1]
        value, cuts = signatures(data[own[0] : own[-1]], own - own[0])
        short = (value >> np.uint64(32)).astype("<u4")
        out += [np.unique(short[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def encoded(sets: list[np.ndarray]) -> list[str]:
    """Fingerprints as text: base64 of the sets' hashes."""
    return [base64.b64encode(s.tobytes()).decode() for s in sets]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Components of documents whose signature sets have a Jaccard similarity of percent / 100 or more.

    The columns are those of jaccard_join.similar_components.  Sets are partitioned by length, and a pair that its
    sizes or its overlap so far rule out is not followed up.
    """
    return jaccard_join.components_of(docs, signatures, percent, length_partitions=True)


def _dealt(bounds: np.ndarray, shares: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The number of each row's run, in the order of runs: descending by id, ascending by hash within an id.

    Run i ends with the id bounds[i].  An id that many bounds fell on, shares[i], has runs of its own, by hash: as many.
    """
    first = np.append(0, np.cumsum(np.where(shares > 1, shares, 0) + 1))
    i = np.searchsorted(bounds, at, side="left")
    own = np.append(shares, 1)[i]
    alone = (own > 1) & (np.append(bounds, np.iinfo(np.int64).max)[i] == at)
    part = ((key.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * own >> 32
    # within run i: the parts of its last id come first, then all smaller ids; runs of larger ids come before
    place = np.where(alone, part, np.where(own > 1, own, 0))
    return (first[-1] - first[np.minimum(i + 1, len(first) - 1)] + np.where(i < len(bounds), 1, 0) + place).astype(np.int32)


def _neighbours(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows in runs of descending doc_id: (run, kind, doc_id, row_key, text, component_id, n_in_component), each run beginning with
    what notes have of its rows and ending with a border row, which is the first row of the next run (after the last run: of the first)."""
    at = F.coalesce("doc_id", F.lit(LOWEST)).alias("at")
    rows = ex.keyed(docs).select("*", at)
    ids = rows.select("row_key", "at")
    n = ids.count()
    none = F.lit(None).cast("long")
    if not n:
        return rows.select(F.lit(0).alias("run"), F.lit(OWN).alias("kind"), "doc_id", "row_key", "text", none.alias("component_id"), none.alias("n_in_component"))
    runs = min(MOST_RUNS, n // RUN_ROWS + 1)
    cuts = ids.agg(F.percentile_approx("at", [i / runs for i in range(1, runs)], min(100 * runs, 1_000_000)).alias("b")).first()["b"] if runs > 1 else []
    bounds, shares = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
    held = docs.sparkSession.sparkContext.broadcast((bounds, shares))

    def deal(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            run = _dealt(*held.value, batch.column("at").to_numpy(), batch.column("row_key").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(run), *batch.columns], names=["run", *batch.schema.names])

    # the first row of each run is the border of the run before it
    tops = ids.mapInArrow(deal, "run int, row_key long, at long").groupBy("run").agg(F.min(F.struct(F.bitwise_not("at").alias("down"), "row_key")).alias("top")).orderBy("run").collect()
    firsts = [(~r["top"]["down"], r["top"]["row_key"], tops[i - 1]["run"]) for i, r in enumerate(tops)]
    firsts = docs.sparkSession.createDataFrame(firsts, "at long, row_key long, run int")
    border = rows.join(F.broadcast(firsts), ["at", "row_key"]).groupBy("run").agg(F.first(F.struct("doc_id", "row_key", "text")).alias("r"))
    border = border.select("run", F.lit(BORDER).alias("kind"), "r.doc_id", "r.row_key", "r.text", F.lit(LOWEST).alias("at"), none.alias("component_id"), none.alias("n_in_component"))
    dealt = rows.mapInArrow(deal, "run int, row_key long, doc_id long, text string, at long").select("run", F.lit(OWN).alias("kind"), "doc_id", "row_key", "text", "at", none.alias("component_id"), none.alias("n_in_component"))
    noted = notes.select("row_key", "doc_id", at, "component_id", F.col("n_in_component").cast("long").alias("n_in_component"))
    noted = noted.mapInArrow(deal, "run int, row_key long, doc_id long, at long, component_id long, n_in_component long").select("run", F.lit(NOTE).alias("kind"), "doc_id", "row_key", F.lit(None).cast("string").alias("text"), "at", "component_id", "n_in_component")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(tops) // TASK_RUNS)
    return noted.unionByName(dealt).unionByName(border).repartition(parts, "run").sortWithinPartitions("run", "kind", F.desc("at"), "row_key").drop("at")


EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64()), ("component_id", pa.int64()), ("n_in_component", pa.int64())])


def _compared(rows: list[tuple], noted: dict) -> pa.RecordBatch:
    """Results of (run, kind, doc_id, row_key, text) rows that have their next row behind them."""
    whole = fingerprints([r[4] for r in rows])
    at = [i for i, r in enumerate(rows[:-1]) if r[1] == OWN]
    pairs = [(rows[i], rows[i + 1]) for i in at]
    texts = [a[4] for a, _ in pairs]
    edited = [a[4][: len(a[4]) - len(a[4]) // 3] + b[4][: len(a[4]) // 3] for a, b in pairs]
    own, nexts, others = [whole[i] for i in at], [whole[i + 1] for i in at], fingerprints(edited)
    told = [noted.get((a[2], a[3]), (a[2], 1)) for a, _ in pairs]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array(encoded(own), pa.string()),
            pa.array(encoded(others), pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, others, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, nexts, strict=True)], pa.float64()),
            pa.array([len(a) for a in own], pa.int64()),
            pa.array([c for c, _ in told], pa.int64()),
            pa.array([n for _, n in told], pa.int64()),
        ],
        schema=EDITED,
    )


def edit_report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """For each row its fingerprint, that of its edited text, how like they and the next row's are, and the component of
    rows with near fingerprints it is in: the smallest doc_id, and how many rows.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    row's, in the order of descending doc_id (equal ids by a hash of the text, null ids last; after the last row the
    first).  Components are near_duplicates() of this percent.  A null text is empty; an empty text has an empty
    fingerprint, two empty ones are alike, and none is in a component with others.  Extra columns are ignored.  No window
    spans the table: rows are dealt into runs by id, an id with very many rows into runs by hash, and every run borrows
    its successor's first row.
    """
    notes = ex.checkpoint(near_duplicates(docs, percent).filter("n_in_component > 1").select("doc_id", "row_key", "component_id", "n_in_component").distinct())
    ex.let_go(docs.sparkSession)
    step = 64

    def run(batches):  # noqa: ANN001, ANN202
        held: list[tuple] = []
        noted, now = {}, None
        for batch in batches:
            names = ("run", "kind", "doc_id", "row_key", "text", "component_id", "n_in_component")
            for number, kind, doc, key, text, component, members in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if number != now:
                    if len(held) > 1:
                        yield _compared(held, noted)
                    held, noted, now = [], {}, number
                if kind == NOTE:
                    noted[doc, key] = component, members
                    continue
                held.append((number, kind, doc, key, text or ""))
                if len(held) > step:
                    yield _compared(held, noted)
                    held = held[step:]
        if len(held) > 1:
            yield _compared(held, noted)

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, component_id long, n_in_component long"
    return _neighbours(docs, notes).select("run", "kind", "doc_id", "row_key", "text", "component_id", "n_in_component").mapInArrow(run, out)
