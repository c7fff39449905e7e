"""Chat formatting: quoted passages linked to the messages they quote, and conversations in reply order.

A line's quote level is the number of ``>`` before its text.  Lines of level 0 are a message's own body; neighbouring
lines of one higher level are a quoted passage.  Passages are normalised (lower case, runs of white space, line ends
too, as one space), hashed, and joined with the bodies, and the paragraphs of bodies, of the same conversation; every
hash belongs to the earliest message that has the passage as its own.  Only of a passage that is found nowhere whole,
as it was cut or put together, the lines are looked for one by one.  A message replies to the message that most of its
quoted text comes from.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex

QUOTE = r"^([ \t>]*>)[ \t]?"
#: Lines that mail programs put above a quotation.
ATTRIBUTION = r"(?i)^\s*(on .{4,200} wrote|am .{4,200} schrieb.{0,100}|le .{4,200} a écrit|el .{4,200} escribió)\s*:\s*$"
HAS_QUOTE = r"(?m)^[ \t]*>"


def _lines(text: Column) -> Column:
    """array<struct<level, text>> of a text's lines."""
    raw = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.transform(raw, lambda line: F.struct(F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[^>]", "")).alias("level"), F.regexp_replace(line, QUOTE, "").alias("text")))


def _body(lines: Column) -> Column:
    """Lines of level 0 without attributions that stand above a quotation, outer blank lines cut."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.rtrim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), r"^\s*\n", ""), F.lit(" \t\n"))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Columns that are put beside those of the conversations on the way.
INNER = ["__key", "__quoted", "__lines"]


def parsed(conversations: DataFrame) -> DataFrame:
    """Messages with their parts: __key, __lines and body; rows equal in all four columns share a key."""
    quoted = F.coalesce(F.col("text").rlike(HAS_QUOTE), F.lit(False))
    keyed = conversations.withColumns({"__key": F.xxhash64("conv_id", "turn", "role", "text"), "__quoted": quoted})
    return ex.once(keyed, "__lines", F.when(F.col("__quoted"), _lines(F.col("text")))).withColumn("body", F.when(F.col("__quoted"), _body(F.col("__lines"))).otherwise(F.coalesce("text", F.lit(""))))


def _passages(lines: Column) -> Column:
    """array<struct<level, lines>>: runs of quoted lines of one level, their lines normalised, without blank ones."""
    level = lambda i: F.get(lines, i)["level"]
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    begins = F.filter(places, lambda i: (level(i) > 0) & ((i == 0) | (level(i - 1) != level(i))))
    ends = F.filter(places, lambda i: (level(i) > 0) & ((i == F.size(lines) - 1) | (level(i + 1) != level(i))))
    own = lambda a, b: F.filter(F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: _normal(x["text"])), lambda x: x != "")
    return F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(level(a).alias("level"), own(a, b).alias("lines"))), lambda x: F.size(x["lines"]) > 0)


#: Kinds of units: what a whole passage can be, and a line of it.
WHOLE, LINE = 0, 1


def _unit(kind: int, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("unit"))


def links(messages: DataFrame) -> DataFrame:
    """(__key, conv_id, turn, parent_turn, quoted_lines, linked_lines) of every distinct message that quotes."""
    known = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = known.filter("__quoted").dropDuplicates(["__key"])
    passages = quoting.select("__key", "conv_id", "turn", F.posexplode(_passages(F.col("__lines"))).alias("p", "q")).select("__key", "conv_id", "turn", "p", "q.level", "q.lines")
    asked = passages.select("__key", "conv_id", "turn", "p", "level", F.explode(F.concat(F.array(_unit(WHOLE, F.array_join("lines", " "))), F.transform("lines", lambda x: _unit(LINE, x)))).alias("u"))
    asked = asked.select("__key", "conv_id", "turn", "p", "level", "u.*").withColumn("h", F.xxhash64("unit"))
    wanted = asked.select("conv_id", "kind", "h").distinct()
    whole = F.concat(F.array(F.col("body")), F.split("body", r"\n[ \t]*\n"))
    units = F.concat(F.transform(whole, lambda x: _unit(WHOLE, _normal(x))), F.transform(F.split("body", "\n"), lambda x: _unit(LINE, _normal(x))))
    own = known.select("conv_id", "turn", F.explode(F.array_distinct(units)).alias("u")).select("conv_id", "turn", "u.*").filter("unit <> ''").withColumn("h", F.xxhash64("unit"))
    # one original for each unit of a conversation, however often it is said: the join can't multiply
    originals = own.join(wanted, ["conv_id", "kind", "h"], "left_semi").groupBy("conv_id", "kind", "h").agg(F.min_by(F.struct("turn", "unit"), "turn").alias("o"))
    met = asked.join(originals, ["conv_id", "kind", "h"], "left").withColumn("parent", F.when((F.col("o.turn") < F.col("turn")) & (F.col("o.unit") == F.col("unit")), F.col("o.turn")))
    line = F.when(F.col("kind") == LINE, F.struct(F.col("parent"), F.length("unit").cast("long").alias("chars"), F.lit(1).cast("long").alias("n")))
    by_passage = met.groupBy("__key", "conv_id", "turn", "p", "level").agg(F.max(F.when(F.col("kind") == WHOLE, F.col("parent"))).alias("whole"), F.collect_list(line).alias("lines"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    votes = F.when(F.col("whole").isNotNull(), F.array(F.struct(F.col("whole").alias("parent"), chars.alias("chars"), F.size("lines").cast("long").alias("n")))).otherwise(F.col("lines"))
    by_parent = by_passage.select("__key", "conv_id", "turn", "level", F.explode(votes).alias("v")).groupBy("__key", "conv_id", "turn", F.col("v.parent").alias("parent")).agg(F.min("level").alias("level"), F.sum("v.chars").alias("chars"), F.sum("v.n").alias("lines"))
    sure = F.col("parent").isNotNull()
    return by_parent.groupBy("__key", "conv_id", "turn").agg(
        F.max_by("parent", F.when(sure, F.struct(-F.col("level"), F.col("chars"), F.col("parent")))).alias("parent_turn"),
        F.sum("lines").alias("quoted_lines"),
        F.sum(F.when(sure, F.col("lines")).otherwise(0)).alias("linked_lines"),
    )


def _threads(found: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of replying turns: the root of the chain of parents, by pointer doubling."""
    # turns said by several messages follow the earliest parent, so a turn has one; parents are always earlier
    step = found.filter("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("thread_turn")).withColumn("depth", F.lit(1))
    step = ex.checkpoint(step)
    while True:
        up = step.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("above"), F.col("depth").alias("more"))
        both = step.join(up, ["conv_id", "thread_turn"], "left")
        after = ex.checkpoint(both.select("conv_id", "turn", F.coalesce("above", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        if not after.filter("moved").take(1):
            return after.drop("moved")
        step = after.drop("moved")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conversations, all columns, with body (the text without quotes), quoted_lines, linked_lines, parent_turn,
    thread_turn, depth, reply_order and chat.

    A conversation is in reply order when sorted by reply_order, (thread_turn, turn) as text: threads by their first
    message, and in a thread every reply behind what it replies to.  A message that quotes nothing found in earlier
    turns of its conversation begins a thread: parent_turn is null, thread_turn its own turn, depth 0.  chat is the message
    in a role-tagged form.  A null text has an empty body; messages without conv_id or turn are never linked.  Repeated
    rows each come back, with equal results.  Columns of these names in conversations are replaced; others are kept.  Results are rows by
    message, so a conversation of any length is never gathered in one place.
    """
    names = ["body", "quoted_lines", "linked_lines", "parent_turn", "thread_turn", "depth", "reply_order", "chat"]
    conversations, back = ex.sheltered(conversations.drop(*names), INNER)
    messages = parsed(conversations)
    found = ex.checkpoint(links(messages))
    placed = found.join(_threads(found), ["conv_id", "turn"], "left").select("__key", "parent_turn", "quoted_lines", "linked_lines", "thread_turn", "depth")
    quoting = messages.filter("__quoted").join(placed, "__key", "left")
    plain = messages.filter("NOT __quoted")
    for c, kind in found.select("parent_turn", "quoted_lines", "linked_lines").dtypes + [("thread_turn", dict(found.dtypes)["parent_turn"]), ("depth", "int")]:
        plain = plain.withColumn(c, F.lit(None).cast(kind))
    out = plain.unionByName(quoting)
    root = F.when(F.col("parent_turn").isNull(), F.col("turn")).otherwise(F.col("thread_turn"))
    # as text in the order of numbers: a negative one by its distance from the smallest, behind a sign that sorts before digits
    number = lambda c: F.transform(F.array(c), lambda n: F.when(n < 0, F.concat(F.lit("-"), F.lpad((n.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"))).otherwise(F.lpad(n.cast("string"), 20, "0")))[0]
    out = out.withColumns({
        "quoted_lines": F.coalesce("quoted_lines", F.lit(0)).cast("long"),
        "linked_lines": F.coalesce("linked_lines", F.lit(0)).cast("long"),
        "thread_turn": root,
        "depth": F.when(F.col("parent_turn").isNull(), F.lit(0)).otherwise(F.col("depth")),
    })
    out = out.withColumns({
        "reply_order": F.concat_ws("/", number(F.col("thread_turn")), number(F.col("turn"))),
        "chat": F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")),
    })
    return out.drop(*INNER).withColumnsRenamed(back)
