import re
from collections import Counter

import pytest

from plumbline.llm import line_dedup, substring_dedup
from plumbline.llm import textcore as tc

LAST = 1 << 70


def rank(row):
    return (LAST if row[0] is None else row[0], row[1] or "")


def brute_substring(clean, least):
    """{doc: (text, spans)}: paragraphs, lines and sentences in order of rank, each compared with the first of its words."""
    first, out = set(), {}
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    for d, t in sorted(clean, key=rank):
        found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        words = [low(t[a:b]) for a, b in found]
        at = [a for a, _ in found] + [len(t or "")]
        breaks = [2 if i == 0 else t[found[i - 1][1] : found[i][0]].count("\n") for i in range(len(found))]
        marks = {
            "paragraph": [b > 1 for b in breaks],
            "line": [b > 0 for b in breaks],
            "sentence": [b > 0 or words[i - 1][-1] in ".!?" for i, b in enumerate(breaks)],
        }
        parts = {k: [i for i, x in enumerate([*m, True]) if x] for k, m in marks.items()}
        units = {k: list(zip(h, h[1:], strict=False)) for k, h in parts.items()}
        wide = [u for k, finer in (("paragraph", "line"), ("line", "sentence")) for u in units[k] if u[1] - u[0] >= least and sum(u[0] <= i < u[1] for i in parts[finer]) > 1]
        short = [u for u in units["sentence"] if u[1] - u[0] >= substring_dedup.SENTENCE_WORDS]
        again = {True: [], False: []}
        for a, b in sorted({*wide, *short}):
            key = tuple(words[a:b])
            if key in first:
                if (a, b) in wide:
                    again[True].append((a, b))
                if (a, b) in short:
                    again[False].append((a, b))
            first.add(key)
        runs = []
        for a, b in again[False]:
            if runs and a - runs[-1][-1][1] <= substring_dedup.BETWEEN:
                runs[-1].append((a, b))
            else:
                runs.append([(a, b)])
        gone = {*again[True], *(u for r in runs if sum(b - a for a, b in r) >= least for u in r)}
        spans = sorted((at[a] << 32) | at[b] for a, b in gone)
        out[d] = (None if t is None else substring_dedup.spans.kept(t, spans), spans)
    return out


def test_substring_dedup_equals_brute_force(rows, spark):
    clean = [r for r in {r[:2] for r in rows} if sum(1 for x in {y[:2] for y in rows} if x[0] == r[0]) == 1]
    for least in (4, 12):
        got = {r.doc_id: (r.text, r.removed_spans or []) for r in substring_dedup.dedup(spark.createDataFrame(clean, "doc_id long, text string").repartition(3), least).collect()}
        want = brute_substring(clean, least)
        assert got == want
        assert any(s for _, s in want.values())


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Passages of sentences, in lines of their own or inside of others; a short line that many texts have stays."""
    import random

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", "", "", "", ".", ","]) for _ in range(n))
    passages = [prose(60) + "." for _ in range(10)]
    rows, planted = [], {}
    for i in range(120):
        text = prose(80)
        if i % 3 == 0:
            p = passages[(i // 3) % len(passages)]
            at = text.index(" ", 100 + i) + 1
            text, planted[i] = text[:at] + (p + " " if i % 2 else f"\n{p}\n") + text[at:], p
        if i % 3 == 1:
            text += "\nAll rights are reserved by us."
        rows.append((i, text))
    out = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen, shares = set(), []
    for i, text in rows:
        if i not in planted or planted[i] not in seen:
            assert out[i].text == text
            seen.add(planted.get(i))
        else:
            shares.append(out[i].removed_chars / len(planted[i]))
    assert sum(shares) / len(shares) > 0.6 and sum(x > 0 for x in shares) / len(shares) > 0.9


def test_one_after_the_other(docs, rows, spark):
    """Columns of either's names are replaced, names of the inner tables clash with none, and repeats of nulls are no harm."""
    from pyspark.sql import functions as F

    odd = docs.withColumns({"row_key": F.lit(7), "_row_key": F.lit(8), "spans": F.lit("x"), "__key": F.lit(9)})
    for one, two in ((substring_dedup, line_dedup), (line_dedup, substring_dedup)):
        out = two.dedup(one.dedup(odd))
        assert out.columns == [*odd.columns, "removed_spans", "removed_chars"]
        got = out.collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert {(r.row_key, r._row_key, r.spans) for r in got} == {(7, 8, "x")}


def test_repeated_rows_and_columns_stay(docs, rows):
    for dedup in (substring_dedup.dedup, line_dedup.dedup):
        out = dedup(docs).collect()
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        assert {r.sig for r in out} == {"clash"}
        assert all((r.text is None) == (r.n_chars is None) for r in out)


M = (1 << 64) - 1


def mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def line_chunks(t):
    """Chunks of two lines at least, line by line from the definition: one ends where the rolled hash is smaller than its neighbours'."""
    lines = (t or "").encode().split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    hashes = []
    for x in lines:
        x = x.removesuffix(b"\n")
        hashes.append(mixed((sum(int(tc._BYTE[b]) * pow(tc._BASE, i, 1 << 64) for i, b in enumerate(x)) + len(x)) & M))
    rolled = [mixed((h * 0x9E3779B97F4A7C15 + (hashes[i - 1] if i else 0)) & M) for i, h in enumerate(hashes)]
    out, begin, at = [], 0, 0
    for i, x in enumerate(lines):
        at += len(x)
        last = i == len(lines) - 1
        if last or 0 < i < len(lines) - 1 and rolled[i - 1] > rolled[i] < rolled[i + 1]:
            out.append((begin, at, i))
            begin = at
    return [(a, b) for (a, b, i), (*_, before) in zip(out, [(0, 0, -1), *out], strict=False) if i - before >= 2]


@pytest.mark.parametrize("fan_in", [4096, 0.002])
def test_line_dedup_equals_brute_force(rows, spark, fan_in, monkeypatch):
    monkeypatch.setattr(line_dedup, "FAN_IN", fan_in)
    clean = [r for r in {r[:2] for r in rows} if sum(1 for x in {y[:2] for y in rows} if x[0] == r[0]) == 1]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(clean, "doc_id long, text string").repartition(3)).collect()}
    seen, want, gone = set(), {}, 0
    for d, t in sorted(clean, key=rank):
        raw, keep, at = (t or "").encode(), b"", 0
        for a, b in line_chunks(t or ""):
            body = raw[a:b].removesuffix(b"\n")
            assert body.count(b"\n") >= 1
            if body in seen:
                keep, at, gone = keep + raw[at:a], b, gone + 1
            seen.add(body)
        want[d] = None if t is None else (keep + raw[at:]).decode()
    assert got == want
    assert gone > 3


def test_chunk_boundaries_resist_shifts():
    lines = [f"line number {i} says {i * i}" for i in range(60)]
    whole = {"\n".join(lines)[a:b].strip() for a, b in line_chunks("\n".join(lines))}
    moved_text = "\n".join(["put in front", *lines])
    moved = {moved_text[a:b].strip() for a, b in line_chunks(moved_text)}
    assert len(whole & moved) >= len(whole) - 3


def test_empty_tables(no_docs):
    assert substring_dedup.dedup(no_docs).count() == 0
    assert line_dedup.dedup(no_docs).count() == 0
