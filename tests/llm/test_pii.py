import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]  # noqa: B023
            if good():
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "@", "a@@b.c", "é", "ü@x.de", "a@b", "a.b@c.d.e@f.gh", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "001.02.3.255", "4785380592391139", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467 1", "+1 (988) 555-2485", "+49 30 123", "+1-2", "++12345678901", "+12.345.678.901", "12", "7", " ", " ", ".", "-", "(", "word", "über", "%", "79927398713", "0000000000000000", "9" * 40]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 12))) for _ in range(1500)]
    return [*made, "", None, "1" * 30000, "x" * 30000 + "@", "1." * 5000, "+1 " * 3000, "é" * 10 + "a@b.co"]


def test_base_spans_equal_patterns(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    want = {}
    for i, t in rows:
        base = plain(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        n = Counter(k for k, *_ in base)
        want[i] = (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said.encode()).hexdigest(), said)
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, ",".join(s for s in r.spans.split(",") if not s.startswith(("term", "secret")))) for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


SECRETS = ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "A7f9Kq2LmZ81xWv4Tn6b"]
NO_SECRETS = ["1" * 40, "abcdefghijklmnopqrstuvwxyz", "a1" * 20, "24be64439e3e49cf46", "x" * 30 + "12345"]


def secrets(text):
    out = []
    for m in re.finditer("[0-9A-Za-z]{20,}", text):
        n = Counter(m[0])
        bits = -sum(x / len(m[0]) * math.log2(x / len(m[0])) for x in n.values())
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(m[0], m[0][1:], strict=False))
        if bits >= pii.SECRET_BITS and changes >= pii.SECRET_CHANGES and not any(a < m.end() and b > m.start() for _, a, b in plain(text)):
            out.append(("secret", m.start(), m.end()))
    return out


def test_secrets():
    for t in SECRETS:
        assert pii.protected_spans(f"é key={t}.".encode())[-1] == (4, 7, 7 + len(t))
    for t in [*NO_SECRETS, f"{SECRETS[0]}@example.com"]:
        assert all(k != 4 for k, *_ in pii.protected_spans(t.encode()))


@pytest.fixture(scope="module")
def told(spark):
    """A name that stands by one address, a host's nickname that stands by all its addresses, a cue that stands by secrets."""
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = [rnd.choice(vocab) for _ in range(60)]
        if i % 10 == 0:
            w[20:20] = ["Quarrywell", "writes", "from", "jo@corp.example.com"]
        if i % 10 == 1:
            w[9:9] = ["Plumeria", "has", f"user{i}@plume.example.net"]
        if i % 10 == 2:
            w[30:30] = ["hush", "=", "".join(rnd.choice("0123456789abcdef") for _ in range(40))]
        if i % 10 == 3:
            w[5:5] = [f"+1 (988) 555-{i:04d}", "or", "10.1.2.3"]
        rows.append((i, " ".join(w)))
    rows += [(1000, "Only Quarrywell stands here, not the address"), (1001, None), (1002, ""), (1000, "Only Quarrywell stands here, not the address")]
    return rows


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def levels(kind, value):
    digits = re.sub("[^0-9]", "", value)
    family = {"email": value.lower().rpartition("@")[2], "ip": value.rpartition(".")[0], "card": digits[:6], "phone": digits[:4], "secret": value}[kind]
    whole = value.lower() if kind == "email" else value if kind in ("ip", "secret") else digits
    return [(kind,), (kind, "family", family), (kind, "value", whole)]


def disclosing(rows):
    """The definition, with every count taken from the texts."""
    n_t, n_e, n_te, contexts, total = Counter(), Counter(), Counter(), defaultdict(set), 0
    for _, t in rows:
        t = t or ""
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))]
        n_t.update(w for w, *_ in words)
        total += len(words)
        spans = plain(t) + secrets(t)
        free = [(w, a, b) for w, a, b in words if not any(a < y and b > x for _, x, y in spans)]
        for k, x, y in spans:
            around = [w for w, _, b in free if b <= x][-pii.REACH :] + [w for w, a, _ in free if a >= y][: pii.REACH]
            for e in levels(k, t[x:y]):
                n_e[e] += 1
                for w in set(around):
                    n_te[e, w] += 1
                    contexts[e, w].add(tuple(around))
    sure = [x for x in n_te if len(contexts[x]) >= pii.LEAST_CONTEXTS]
    bad = set()
    for e, w in sure:
        own, pmi = math.log2(total / n_e[e]), math.log2(n_te[e, w] * total / (n_t[w] * n_e[e]))
        bits = len(contexts[e, w]) * (own - math.log2(2 * pii.REACH)) - min(n_t[w], 2 * n_te[e, w])
        if pmi >= pii.DISCLOSURE * own and bits >= pii.SURE_BITS + math.log2(len(sure)):
            bad.add(w)
    return bad


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_disclosing_terms_equal_brute_force(spark, told, broadcast, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", broadcast)
    bad = disclosing(told)
    assert {"quarrywell", "plumeria", "hush"} <= bad and not any(w.startswith("w") and w[1:].isdigit() for w in bad)
    out = pii.report(spark.createDataFrame(told, "doc_id long, text string").repartition(2)).collect()
    assert len(out) == len(told)
    texts = defaultdict(list)
    for d, t in told:
        texts[d].append(t or "")
    for r in out:
        t = texts[r.doc_id][0]
        spans = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] == "secret"] == secrets(t)
        own = plain(t) + secrets(t)
        want = [("term", m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if m[0] in bad and not any(m.start() < y and m.end() > x for _, x, y in own)]
        assert [s for s in spans if s[0] == "term"] == want
        assert r.n_pii == len(spans) == sum(r[f"n_{k}"] for k in pii.KINDS) and r.has_pii == (len(spans) > 0)
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert clean[1000] == "Only <term> stands here, not the address"
    assert "<email>" in clean[0] and "corp" not in clean[0] and clean[1001] is None and "<secret>" in clean[2] and "hush" not in clean[2]


def test_terms_are_found_in_the_tables(spark):
    """The cue that stands before secrets is the one term that gives something away; documents without protected data keep clean."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = pii.report(docs).collect()
    found = Counter(texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])].lower() for r in out for s in r.spans.split(",") if s.startswith("term"))
    assert found["token"] > 5
    wrong = [r.doc_id for r in out if r.has_pii and r.n_pii == r.n_term]
    assert len(wrong) < 0.005 * len(out)


def test_many_addresses_take_linear_time():
    import time

    text = "".join(f"word{i} x{i}@b.co some more words here and there too now " for i in range(100_000)).encode()
    began = time.time()
    assert len(pii.protected_spans(text)) == 100_000
    assert len(pii.base_spans(b"@b.c " * 200_000)) == 0
    assert time.time() - began < 10


def test_other_tables(docs, rows, no_docs):
    assert pii.report(docs).count() == len(rows)
    assert pii.report(no_docs).count() == 0
    odd = docs.selectExpr("*", "1 AS row_key", "2 AS spans", "3 AS __row_key", "4 AS __spans")
    out = pii.sanitise(odd)
    assert out.columns == odd.columns
    assert {(r.row_key, r.spans, r["__row_key"], r["__spans"]) for r in out.collect()} == {(1, 2, 3, 4)} and out.count() == len(rows)
