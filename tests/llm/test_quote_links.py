import itertools
import random
import re
from collections import Counter

import pytest

from plumbline.llm import quote_links

SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed=3):
    rnd = random.Random(seed)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rnd.randrange(1, 9)):
            own = "\n".join(" ".join(rnd.choice(["we", "go", "now", "Then", "why", "so"]) + str(rnd.randrange(40)) for _ in range(5)) for _ in range(rnd.randrange(1, 4)))
            quote = ""
            if texts and rnd.random() < 0.6:
                whole = rnd.choice(texts)
                lines = whole.split("\n")
                part = lines if rnd.random() < 0.5 else lines[: max(1, len(lines) // 2)]
                quote = "\n".join(rnd.choice(["> ", ">", " > "]) + x.upper().replace(" ", "  ") for x in part) + "\n"
                if rnd.random() < 0.4:
                    quote = "On Monday, someone wrote:\n" + quote
            text = own + "\n\n" + quote if rnd.random() < 0.3 else quote + own
            texts.append(text)
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), text))
    rows += [(50, 0, None, "> quotes what nobody said\nyes"), (50, 1, "user", None), (50, 2, "user", ""), (None, 3, "user", "> a\nb"), (51, None, "user", "> a\nb"), rows[5], rows[5], (52, 0, "user", "same"), (52, 0, "assistant", "same"), (52, 1, "user", ">same\nno"), (53, 0, "user", ">>> deep\n>> less\n> one\nown"), (54, 2, "user", "x"), (54, 1, "user", "> x\nlater is no original"), (55, 0, "user", "> " * 3000 + "z")]
    # whole passages, paragraphs and rewrapped lines; a negative turn comes first
    rows += [(60, -3, "user", "ok"), (60, 0, "user", "One thing.\n\nAnother thing\nin two lines.\n"), (60, 1, "assistant", "yes\nok\nno"), (60, 2, "user", "> yes\n> ok\n> no\nquoted whole"), (60, 3, "user", "> another\n> thing in two\n> lines.\nrewrapped"), (60, 4, "user", "> ok\nshort"), (60, 5, "user", "> ok\n> nobody said this\npartly"), (60, 6, "user", ">> ok\n> One thing.\nnested")]
    return rows


def brute(rows):
    def lines(text):
        out = []
        for line in re.split("\r\n|\r|\n", text or ""):
            m = re.match(r"^((?:[ \t]*>)+)[ \t]?", line)
            out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
        return out

    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    attribution = re.compile(quote_links.ATTRIBUTION)

    def body(text):
        ls = lines(text)
        if not re.search(r"(?m)^[ \t]*>", text or ""):
            return text or ""
        own = [t for i, (lv, t) in enumerate(ls) if lv == 0 and not (attribution.match(t) and i + 1 < len(ls) and ls[i + 1][0] > 0)]
        return re.sub(r"^\s*\n", "", "\n".join(own)).rstrip(" \t\n")

    first = {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        own = body(text)
        for kind, units in (("line", own.split("\n")), ("whole", [own, *re.split(r"\n[ \t]*\n", own)])):
            for t in units:
                if norm(t):
                    first[conv, kind, norm(t)] = min(first.get((conv, kind, norm(t)), turn), turn)
    parent, stats = {}, {}
    for row in set(rows):
        conv, turn, _, text = row
        passages = []
        for lv, group in itertools.groupby(lines(text), key=lambda x: x[0]):
            own = [norm(t) for _, t in group if norm(t)]
            if lv and own and conv is not None and turn is not None:
                passages.append((lv, own))
        quotes, votes = [q for _, own in passages for q in own], {}
        for lv, own in passages:
            o = first.get((conv, "whole", " ".join(own)))
            found = [(o, q) for q in own] if o is not None and o < turn else [(first.get((conv, "line", q)), q) for q in own]
            for o, q in found:
                if o is not None and o < turn:
                    level, chars, n = votes.get(o, (9999, 0, 0))
                    votes[o] = (min(level, lv), chars + len(q), n + 1)
        best = max(votes, key=lambda o: (-votes[o][0], votes[o][1], o)) if votes else None
        stats[row] = (best, len(quotes), sum(v[2] for v in votes.values()))
        if best is not None:
            parent[conv, turn] = min(parent.get((conv, turn), best), best)

    def root(conv, turn):
        depth = 0
        while (conv, turn) in parent:
            turn, depth = parent[conv, turn], depth + 1
        return turn, depth

    out = Counter()
    for row in rows:
        best, n, linked = stats[row]
        thread, depth = root(*row[:2]) if best is not None else (row[1], 0)
        out[(*row, body(row[3]), n, linked, best, thread, depth)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    return made()


def test_reply_order_equals_brute_force(spark, rows):
    out = quote_links.reply_ordered(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.body, r.quoted_lines, r.linked_lines, r.parent_turn, r.thread_turn, r.depth) for r in out)
    want = brute(rows)
    assert got == want
    assert sum(k[7] is not None for k in want) > 10 and max(k[9] for k in want) > 1
    for conv in {r.conv_id for r in out}:
        seen = set()
        for r in sorted((r for r in out if r.conv_id == conv and r.reply_order), key=lambda r: r.reply_order):
            assert r.parent_turn is None or r.parent_turn in seen
            seen.add(r.turn)


def test_plan_is_native_and_extra_columns_stay(spark, rows):
    from pyspark.sql import functions as F

    df = quote_links.reply_ordered(spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit("clash")).withColumn("__key", F.lit(5)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert {(r.h, r["__key"]) for r in df.collect()} == {("clash", 5)}


def test_empty_table(spark):
    assert quote_links.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_duckdb_says_the_same(spark, rows):
    import duckdb
    from oracle import compare

    from plumbline.llm import oracles

    distinct = list(dict.fromkeys(rows))
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", distinct)
    compare(quote_links.reply_ordered(spark.createDataFrame(distinct, SCHEMA)).drop("text"), c, oracles.QUOTE_LINKS)
