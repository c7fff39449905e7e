"""DuckDB-flavoured SELECT text to Spark SQL text.

Spark parses, analyses and plans; this module only rewrites what the two dialects mean differently.  It works on a
tree of tokens and parenthesised groups.  Where a rewrite depends on a type (integer sums, decimal averages, casts that
round), Catalyst is asked for it: the expression is analysed over the block's own FROM clause, without running.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from plumbline.functions.sem import LOWER, UPPER

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<tick>`(?:[^`]|``)*`)"""
    r"""|(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_\u0080-\uffff][\w$\u0080-\uffff]*)"""
    r"""|(?P<op>::|//|\|\||<=>|<>|!=|<=|>=|=>|->|[-+*/%=<>(),.;\[\]:?@])""",
    re.S,
)
#: Words that end an operand at their level.
CLAUSE = set("SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT WINDOW QUALIFY ON USING JOIN INNER LEFT RIGHT FULL CROSS OUTER SEMI ANTI NATURAL LATERAL WITH AS BY ALL DISTINCT".split())
STOP = CLAUSE | set("AND OR NOT IN LIKE ILIKE BETWEEN IS WHEN THEN ELSE CASE END ASC DESC NULLS ROWS RANGE GROUPS OVER FILTER VALUES ESCAPE SIMILAR EXISTS ANY SOME".split())
TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "HUGEINT": "DECIMAL(38,0)", "TIMESTAMP": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ", "INT8": "BIGINT", "INT4": "INT", "INT2": "SMALLINT", "FLOAT8": "DOUBLE", "USMALLINT": "INT", "REAL": "FLOAT"}
AGGREGATES = set("count sum avg min max stddev stddev_samp stddev_pop variance var_samp var_pop any_value first last count_star bool_and bool_or mode median".split())
INTEGRAL = ("tinyint", "smallint", "int", "bigint")
COMPARISONS = ("=", "<>", "!=", "<", ">", "<=", ">=")


class DialectError(ValueError):
    """Text that can't be read as a query."""


@dataclass
class Tok:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "op" else ""


@dataclass
class Group:
    items: list = field(default_factory=list)
    up: str = "("
    kind: str = "group"


def raw(text: str) -> Tok:
    """Text that is Spark's already."""
    return Tok("raw", text)


def tokens(sql: str) -> list[Tok]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Tok(m.lastgroup, m.group()))
        at = m.end()
    while out and out[-1].text == ";":
        out.pop()
    return out


def tree(toks: list[Tok]) -> list:
    stack: list[list] = [[]]
    for t in toks:
        if t.text == "(" and t.kind == "op":
            g = Group()
            stack[-1].append(g)
            stack.append(g.items)
        elif t.text == ")" and t.kind == "op":
            if len(stack) == 1:
                raise DialectError("unmatched )")
            stack.pop()
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise DialectError("unmatched (")
    return stack[0]


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_of(t: Tok) -> str:
    return t.text[1:-1].replace("''", "'")


def show(nodes: list) -> str:
    """Tokens as Spark text."""
    out: list[str] = []
    for n in nodes:
        if isinstance(n, Group):
            piece = f"({show(n.items)})"
        elif n.kind == "string":
            piece = literal(value_of(n))
        elif n.kind == "quoted":
            piece = "`" + n.text[1:-1].replace('""', '"').replace("`", "``") + "`"
        else:
            piece = n.text
        if out and (piece in (".", ",", ":") or out[-1].endswith(".") and n.kind != "number" and out[-1] == "." or piece.startswith("(") and out[-1] and nodes and isinstance(n, Group) and re.fullmatch(r"[A-Za-z_]\w*", out[-1]) and out[-1].upper() not in STOP):
            out.append(piece)
        else:
            out += [" ", piece] if out else [piece]
    return "".join(out).replace(" .", ".")


def split(nodes: list, at: str = ",") -> list[list]:
    parts: list[list] = [[]]
    for n in nodes:
        if n.kind == "op" and n.text == at:
            parts.append([])
        else:
            parts[-1].append(n)
    return parts


def is_query(g: object) -> bool:
    return isinstance(g, Group) and bool(g.items) and (g.items[0].up in ("SELECT", "WITH", "VALUES") or is_query(g.items[0]))


@dataclass
class Scope:
    """What a rewrite may ask about: analyse(expressions) gives their Spark types over the block's FROM, or None."""

    types: Callable[[list[str]], list[str] | None]
    #: Whether an IN (subquery) here is seen as a value, NULL included.
    mark: bool = False
    #: Whether this is the top of a WHERE clause; whether rows, not groups, are looked at.
    where: bool = False
    rows: bool = False
    #: FROM and WHERE of a block that needs nothing of others and has no groups: what a window over everything sees.
    everything: str = ""

    def value(self) -> Scope:
        return Scope(self.types, True, False, self.rows, self.everything)

    def inside(self) -> Scope:
        return Scope(self.types, self.mark, False, self.rows, self.everything)

    def type_of(self, text: str) -> str:
        found = self.types([text])
        return found[0] if found else ""


class Translator:
    """Rewrites one statement.  analyse(sql) gives the types of a query's columns, or None if it can't be analysed."""

    def __init__(self, analyse: Callable[[str], list[str] | None] | None = None, columns: Callable[[str], list[str] | None] | None = None, first_of_group: bool = False) -> None:
        self.analyse = analyse or (lambda _: None)
        self.columns = columns or (lambda _: None)
        #: Whether subqueries as values in the select list of a grouped block are wrapped in an aggregate: their outer columns
        #: are keys, so any row of the group gives the value, but Spark doesn't see that by itself.
        self.first_of_group = first_of_group
        #: Select items that only the outer ORDER BY needs; the caller drops them.
        self.hidden: list[str] = []
        #: FROM clauses of the blocks around, whose columns a subquery may use.
        self.outers: list[str] = []
        #: Expressions whose type a rewrite needs and can't find out: the result can't be trusted.
        self.unknown: list[str] = []

    def statement(self, sql: str) -> str:
        return show(self.query(tree(tokens(sql)), "", top=True))

    # -- blocks ---------------------------------------------------------------------------------------------------

    def query(self, nodes: list, ctes: str, top: bool = False, nested: bool = False) -> list:
        out = []
        if nodes and nodes[0].up == "WITH":
            body = next(i for i, n in enumerate(nodes) if n.up == "SELECT" or (is_query(n) and nodes[i - 1].up != "AS" and nodes[i - 1].up != "MATERIALIZED"))
            made, inner = [], ctes
            for part in split(nodes[1:body]):
                part = [self.inner(n, inner) if is_query(n) else n for n in part]
                if len(part) > 1 and part[1].up == "AS":  # without names of its own
                    own = self.columns(f"{inner} SELECT * FROM {show(part[-1:])} AS x".strip()) or []
                    if numbered(own) != own:
                        part.insert(1, Group([raw(", ".join(f"`{n}`" for n in numbered(own)))]))
                made.append(part)
                inner = (inner + ", " if inner else "WITH ") + show(part)
            out.append(nodes[0])
            for i, part in enumerate(made):
                out += ([Tok("op", ",")] if i else []) + part
            nodes, ctes = nodes[body:], inner
        # set operations: blocks between them, the ORDER BY and LIMIT of all at the end
        blocks: list[list] = [[]]
        seps: list[list] = []
        i = 0
        while i < len(nodes):
            if nodes[i].up in ("UNION", "INTERSECT", "EXCEPT"):
                sep = [nodes[i]]
                if i + 1 < len(nodes) and nodes[i + 1].up in ("ALL", "DISTINCT"):
                    i += 1
                    sep.append(nodes[i])
                seps.append(sep)
                blocks.append([])
            else:
                blocks[-1].append(nodes[i])
            i += 1
        for i, b in enumerate(blocks):
            out += self.block(b, ctes, top and not seps, nested) + (seps[i] if i < len(seps) else [])
        return out

    def inner(self, g: Group, ctes: str) -> Group:
        return Group(self.query(g.items, ctes, nested=True) if not is_query(g.items[0]) or len(g.items) > 1 else [self.inner(g.items[0], ctes)])

    def known(self, text: str, scope: Scope) -> str:
        """The Spark type of an expression; one that can't be found out is remembered."""
        found = scope.type_of(text)
        if not found:
            self.unknown.append(text)
        return found

    def types_of(self, exprs: list[str], ctes: str, source: str, groups: str, items: list[str], outers: list[str], windows: str = "") -> list[str] | None:
        """Types of expressions of a block: as they are, by its groups, behind its select items (whose names they may use), and
        below the blocks around."""
        own = [f"{e} AS c{i}" for i, e in enumerate(exprs)]
        texts = [f"SELECT {', '.join(x)} {source} {g} {windows}" for x in ([own, [*items, *own]] if items else [own]) for g in dict.fromkeys(["", groups])]
        for depth in range(len(outers) + 1):
            for text in texts:
                for outer in outers[::-1][:depth]:
                    text = f"SELECT q.* FROM {outer}, LATERAL ({text}) AS q"
                found = self.analyse(f"{ctes} {text}".strip())
                if found:
                    return found[-len(exprs) :]
        return None

    def block(self, nodes: list, ctes: str, top: bool, nested: bool, totals: bool = True) -> list:
        clauses = self.clauses(nodes)
        kinds = {k for k, _ in clauses}
        total = self.with_total(clauses, ctes) if totals and {"GROUP", "FROM"} <= kinds else None
        if total is not None:
            return self.block(total, ctes, top, nested)
        if nested and not kinds & {"LIMIT", "OFFSET"}:  # the order of a nested result means nothing
            clauses = [(k, c) for k, c in clauses if k != "ORDER"]
        source = next((c for k, c in clauses if k == "FROM"), None)
        done: dict[int, list] = {}
        from_text, outers = "", self.outers
        if source is not None:
            self.outers = []
            done[id(source)] = self.source(source, ctes)
            from_text = show(done[id(source)])
        self.outers = [*outers, from_text[5:]] if from_text else outers
        groups = next((show(c) for k, c in clauses if k == "GROUP" and not any(n.up in ("ROLLUP", "CUBE", "SETS") or n.kind == "number" for n in self.flat(c))), "")
        windows = next((show(self.expr(c, Scope(lambda _: None), ctes)) for k, c in clauses if k == "WINDOW"), "")
        items: list[str] = []
        rows = "GROUP" not in kinds and "HAVING" not in kinds and not any(self.aggregates(c) for k, c in clauses if k == "SELECT")
        told: dict[str, str] = {}

        def types(exprs: list[str]) -> list[str] | None:
            if not told:  # what the block will ask for, in one analysis
                asked = list(dict.fromkeys(x for k, c in clauses if k in ("SELECT", "HAVING", "ORDER") for x in self.arguments(c)))
                found = self.analyse(f"{ctes} SELECT {', '.join(f'{e} AS c{i}' for i, e in enumerate(asked))} {from_text}".strip()) if len(asked) > 1 else None
                told.update(dict(zip(asked, found, strict=True)) if found else {"": ""})
            if all(e in told for e in exprs):
                return [told[e] for e in exprs]
            return self.types_of(exprs, ctes, from_text, groups, items, outers, windows)

        scope = Scope(types, rows=rows)
        if rows and from_text and any(n.up == "OVER" for k, c in clauses if k == "SELECT" for n in self.level(c)):
            where = next((show([c[0], *self.expr(c[1:], Scope(scope.types, where=True, rows=True), ctes)]) for k, c in clauses if k == "WHERE"), "")
            if self.analyse(f"{ctes} SELECT 1 AS c {from_text} {where}".strip()):
                scope.everything = f"{from_text} {where}"
        out, select_at = [], None
        for kind, c in clauses:
            if kind == "FROM":
                out += done[id(c)]
            elif kind == "SELECT":
                select_at = len(out)
                how = c[1:2] if len(c) > 1 and c[1].up in ("DISTINCT", "ALL") else []
                made = [*how]
                for item in split(c[1 + len(how) :]):
                    one = self.expr(item, scope.value(), ctes)
                    if self.first_of_group and "GROUP" in kinds:
                        one = [raw(f"any_value({show([n])})") if is_query(n) and not (i and one[i - 1].up in ("IN", "EXISTS")) else n for i, n in enumerate(one)]
                    made += ([Tok("op", ",")] if items else []) + one
                    items.append(show(one))
                out += [c[0], *made]
                select_at = (select_at, len(out))
            elif kind == "GROUP":
                if len(c) == 3 and isinstance(c[2], Group) and not c[2].items:
                    continue
                out += self.expr(c, scope.value(), ctes)
            elif kind == "ORDER":
                ordered, moved = [], []
                for item in split(c[2:]):
                    done_item = self.order_item(item, scope, ctes)
                    if top and select_at and any(is_query(n) for n in self.flat(item)):
                        name = f"__order_{len(self.hidden)}"
                        self.hidden.append(name)
                        tail = next((i for i, n in enumerate(done_item) if n.up in ("ASC", "DESC", "NULLS")), len(done_item))
                        moved += [Tok("op", ","), *done_item[:tail], Tok("word", "AS"), Tok("word", name)]
                        done_item = [Tok("word", name), *done_item[tail:]]
                    ordered += ([Tok("op", ",")] if ordered else []) + done_item
                if moved:
                    out = out[: select_at[1]] + moved + out[select_at[1] :]
                out += [*c[:2], *ordered]
            elif kind == "WHERE":
                out += [c[0], *self.expr(c[1:], Scope(scope.types, where=True, rows=True), ctes)]
            else:
                out += self.expr(c, scope, ctes)
        self.outers = outers
        limits = [c for k, c in clauses if k == "LIMIT"]
        offsets = [c for k, c in clauses if k == "OFFSET"]
        kinds = [k for k, _ in clauses]
        if limits and offsets and kinds.index("OFFSET") < kinds.index("LIMIT"):
            tail = sum(len(c) for c in limits + offsets)
            out = out[:-tail] + limits[0] + offsets[0]
        return out

    def with_total(self, clauses: list[tuple[str, list]], ctes: str) -> list | None:
        """A block with grouping sets that have the empty one among them, and its row over empty input, which Spark leaves out.

        That row is a second block over no rows, kept only if the input has none; Catalyst folds the former and asks for one
        row of the latter.
        """
        of = dict(clauses)
        elements = split(of["GROUP"][2:])
        sets = [e for e in elements if e and e[0].up in ("ROLLUP", "CUBE", "GROUPING")]
        if not sets or len(sets) < len(elements) or any(e[0].up == "GROUPING" and not any(isinstance(n, Group) and not n.items or n.up in ("ROLLUP", "CUBE") for p in split(e[-1].items) for n in p) for e in sets):
            return None
        keys: list[list] = []

        def collect(nodes: list) -> None:
            for part in split(nodes):
                part = [n for n in part if n.up not in ("ROLLUP", "CUBE", "GROUPING", "SETS")]
                if len(part) == 1 and isinstance(part[0], Group):
                    collect(part[0].items)
                elif part:
                    keys.append(part)

        for e in sets:
            collect(e)
        source = show(self.source(of["FROM"], ctes))
        types = self.analyse(f"{ctes} SELECT {', '.join(f'{show(k)} AS c{i}' for i, k in enumerate(keys))} {source}".strip())
        if not types or any("__total" in show([n]) for n in of["FROM"]):
            return None
        word = lambda n: n.text.strip('"`').lower() if isinstance(n, Tok) else show([n]).lower()
        names = [[word(n) for n in k] for k in keys]

        def empty(nodes: list) -> list:
            out: list = []
            i = 0
            while i < len(nodes):
                n = nodes[i]
                if n.up in ("GROUPING", "GROUPING_ID") and i + 1 < len(nodes) and isinstance(nodes[i + 1], Group):
                    out.append(raw(f"CAST({(1 << (len(split(nodes[i + 1].items)) if nodes[i + 1].items else len(keys))) - 1} AS BIGINT)"))
                    i += 2
                    continue
                for k, kind in sorted(zip(names, types, strict=True), key=lambda x: -len(x[0])):
                    alias = i and (nodes[i - 1].up == "AS" or nodes[i - 1].text == "." if isinstance(nodes[i - 1], Tok) else False)
                    qualified = i + 2 < len(nodes) and len(k) == 1 and isinstance(nodes[i + 1], Tok) and nodes[i + 1].text == "." and word(nodes[i + 2]) == k[0]
                    if not alias and ([word(x) for x in nodes[i : i + len(k)]] == k or len(k) == 3 and k[1] == "." and word(n) == k[2]) and not (i + len(k) < len(nodes) and isinstance(nodes[i + len(k)], Group) and len(k) == 1 and nodes[i].kind == "word"):
                        out.append(raw(f"CAST(NULL AS {kind})"))
                        i += len(k) if [word(x) for x in nodes[i : i + len(k)]] == k else 1
                        break
                    if not alias and qualified:
                        out.append(raw(f"CAST(NULL AS {kind})"))
                        i += 3
                        break
                else:
                    out.append(n if not isinstance(n, Group) or is_query(n) else Group(empty(n.items)))
                    i += 1
            return out

        order, limits = of.get("ORDER"), [c for k, c in clauses if k in ("LIMIT", "OFFSET")]
        where = of.get("WHERE", [])
        hidden: list[list] = []
        select = of["SELECT"]
        plain = {word(p[-1]) for p in split(select[1:]) if len(p) > 1 and (p[-2].up == "AS" or isinstance(p[-1], Tok) and p[-1].kind in ("word", "quoted") and not (isinstance(p[-2], Tok) and p[-2].text == "."))} | {word(p[0]) for p in split(select[1:]) if len(p) == 1 and isinstance(p[0], Tok)}
        sorted_by: list = []
        for item in split(order[2:]) if order else ():
            at = next((i for i, n in enumerate(item) if n.up in ("ASC", "DESC", "NULLS")), len(item))
            if not (at == 1 and isinstance(item[0], Tok) and (item[0].kind == "number" or word(item[0]) in plain)):
                hidden.append(item[:at])
                item = [Tok("word", f"__total_{len(hidden) - 1}"), *item[at:]]
            sorted_by += ([Tok("op", ",")] if sorted_by else []) + item
        more = [n for i, h in enumerate(hidden) for n in (Tok("op", ","), *h, Tok("word", "AS"), Tok("word", f"__total_{i}"))]
        word_ = lambda t: Tok("word", t)
        kept = [word_("AND"), Group(empty(of["HAVING"][1:]))] if "HAVING" in of else []
        window = of.get("WINDOW", [])
        first = [*select, *more, *of["FROM"], *where, *of["GROUP"], *of.get("HAVING", []), *window]
        second = [*select[:1], *empty(select[1:]), *empty(more), *of["FROM"], word_("WHERE"), *([Group(where[1:]), word_("AND")] if where else []), raw("false"), word_("HAVING"), raw("count(*) = 0"), *kept, *window]
        any_row = [word_("SELECT"), Tok("number", "1"), *of["FROM"], *where]
        inner = Group([word_("SELECT"), Tok("op", "*"), word_("FROM"), Group([*second]), word_("AS"), word_("__total"), word_("WHERE"), word_("NOT"), word_("EXISTS"), Group(any_row)])
        made = [raw(show(self.block(first, ctes, False, True, totals=False))), word_("UNION"), word_("ALL"), raw(show(self.query(inner.items, ctes, nested=True)))]
        star = [Tok("op", "*")] + ([raw(f"EXCEPT ({', '.join(f'__total_{i}' for i in range(len(hidden)))})")] if hidden else [])
        return [word_("SELECT"), *star, word_("FROM"), raw(f"({show(made)}) AS __total"), *([*order[:2], *sorted_by] if order else []), *[n for c in limits for n in c]]

    def arguments(self, nodes: list) -> list[str]:
        """Arguments of sums and averages outside of subqueries, as they stand."""
        out = []
        for i, n in enumerate(nodes):
            if isinstance(n, Group) and not is_query(n):
                if i and isinstance(nodes[i - 1], Tok) and nodes[i - 1].text.lower() in ("sum", "avg") and n.items:
                    out.append(show(n.items[1:] if n.items[0].up == "DISTINCT" else n.items))
                else:
                    out += self.arguments(n.items)
        return out

    def aggregates(self, nodes: list) -> bool:
        """Whether there is an aggregate, not a window, outside of subqueries."""
        for i, n in enumerate(nodes):
            if isinstance(n, Group):
                if not is_query(n) and self.aggregates(n.items) and not (i and nodes[i - 1].up == "OVER"):
                    return True
            elif n.text.lower() in AGGREGATES and i + 1 < len(nodes) and isinstance(nodes[i + 1], Group):
                behind = i + 2 + (2 if i + 2 < len(nodes) and nodes[i + 2].up == "FILTER" else 0)
                if not (behind < len(nodes) and nodes[behind].up == "OVER"):
                    return True
        return False

    def level(self, nodes: list) -> list:
        """Tokens of a block but not of its subqueries."""
        return [x for n in nodes for x in ([n] if isinstance(n, Tok) else [] if is_query(n) else self.level(n.items))]

    def flat(self, nodes: list) -> list:
        return [x for n in nodes for x in ([n, *self.flat(n.items)] if isinstance(n, Group) else [n])]

    @staticmethod
    def clauses(nodes: list) -> list[tuple[str, list]]:
        heads = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "WINDOW")
        out: list[tuple[str, list]] = []
        for i, n in enumerate(nodes):
            begins = n.up in heads and not (n.up == "FROM" and i and nodes[i - 1].up == "DISTINCT" and i > 1 and nodes[i - 2].up in ("IS", "NOT"))
            if begins or not out:
                out.append((n.up, [n]))
            else:
                out[-1][1].append(n)
        return out

    def source(self, nodes: list, ctes: str) -> list:
        """A FROM clause: paths become tables, derived tables are rewritten, ON conditions too."""
        out: list = []
        i = 0
        while i < len(nodes):
            n = nodes[i]
            before = nodes[i - 1].up if i else ""
            if n.kind == "string" and before in ("FROM", "JOIN", ","):
                path = value_of(n)
                out.append(raw(f"parquet.`{path}`"))
                if i + 1 >= len(nodes) or nodes[i + 1].up in STOP | {","} and nodes[i + 1].up != "AS":
                    name = path.rsplit("/", 1)[-1].split(".")[0]
                    out += [Tok("word", "AS"), raw(f"`{name}`")]
            elif is_query(n):
                out.append(self.inner(n, ctes))
                i = self.named(nodes, i, out, f"{ctes} SELECT * FROM {show([out[-1]])} AS x")
            elif n.kind in ("word", "quoted") and before in ("FROM", "JOIN", ",") and n.up not in STOP and not (i + 1 < len(nodes) and isinstance(nodes[i + 1], Group)):
                out.append(n)
                i = self.named(nodes, i, out, f"{ctes} SELECT * FROM {show([n])}")
            elif isinstance(n, Group) and before in ("FROM", "JOIN", ","):
                out.append(Group(self.source([Tok("word", "FROM"), *n.items], ctes)[1:]))
            elif n.up == "ON":
                end = i + 1
                while end < len(nodes) and not (nodes[end].up in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "SEMI", "ANTI", "NATURAL") and not (end + 1 < len(nodes) and isinstance(nodes[end + 1], Group))) and not (nodes[end].kind == "op" and nodes[end].text == ","):
                    end += 1
                so_far = show(out)
                out += [n, *self.expr(nodes[i + 1 : end], Scope(lambda e, s=so_far: self.analyse(f"{ctes} SELECT {', '.join(e)} {s}".strip())), ctes)]
                i = end
                continue
            else:
                out.append(n)
            i += 1
        return out

    def named(self, nodes: list, i: int, out: list, query: str) -> int:
        """[AS] alias (a, b): names for the first columns, the others keep theirs; a repeated name gets a number."""
        j = i + 1
        if j < len(nodes) and nodes[j].up == "AS":
            j += 1
        alias = nodes[j] if j < len(nodes) and nodes[j].kind in ("word", "quoted") and nodes[j].up not in STOP else None
        listed = alias is not None and j + 1 < len(nodes) and isinstance(nodes[j + 1], Group) and not is_query(nodes[j + 1])
        if not listed and not isinstance(nodes[i], Group):
            return i
        own = self.columns(query.strip())
        given = [show(n).strip("`") for n in split(nodes[j + 1].items)] if listed else []
        if not own or len(given) > len(own):
            return i
        names = numbered([*given, *own[len(given) :]])
        if names == own and not listed or names == given:
            return i
        out += [Tok("word", "AS"), alias or raw("unnamed_subquery"), Group([raw(", ".join(f"`{n}`" for n in names))])]
        return j + listed if alias is not None else i

    def order_item(self, item: list, scope: Scope, ctes: str) -> list:
        made = self.expr(item, scope.value(), ctes)
        return made if any(n.up == "NULLS" for n in item) else [*made, Tok("word", "NULLS"), Tok("word", "LAST")]

    # -- expressions ----------------------------------------------------------------------------------------------

    def expr(self, nodes: list, scope: Scope, ctes: str) -> list:
        """Bottom up: groups and calls, then casts, quantified comparisons and memberships, then division."""
        out: list = []
        i = 0
        while i < len(nodes):
            n = nodes[i]
            nxt = nodes[i + 1] if i + 1 < len(nodes) else None
            if is_query(n):
                out.append(self.inner(n, ctes))
            elif n.kind == "word" and isinstance(nxt, Group) and (n.up not in STOP or n.up in ("LEFT", "RIGHT")):
                i += 1
                over, chosen = None, []
                if i + 2 < len(nodes) and nodes[i + 1].up == "FILTER" and isinstance(nodes[i + 2], Group):
                    chosen = [nodes[i + 1], Group(self.expr(nodes[i + 2].items, scope, ctes))]
                    i += 2
                if i + 1 < len(nodes) and nodes[i + 1].up == "OVER" and i + 2 < len(nodes):
                    over = self.window(nodes[i + 2], scope, ctes) if isinstance(nodes[i + 2], Group) else nodes[i + 2]
                    i += 2
                out += self.call(n, nxt, over, scope, ctes, chosen)
            elif isinstance(n, Group):
                seen = nxt is not None and nxt.up == "IS" or scope.mark
                out.append(Group(self.items(n.items, scope.value() if seen else scope.inside(), ctes)))
            elif n.up == "TIMESTAMP" and nxt is not None and nxt.kind == "string":
                out.append(raw(f"TIMESTAMP_NTZ {literal(value_of(nxt))}"))
                i += 1
            elif n.up in ("LIKE", "ILIKE") and nxt is not None:  # a backslash is an ordinary character
                end = i + 1
                while end < len(nodes) and nodes[end].up not in STOP and not (nodes[end].kind == "op" and nodes[end].text in (",", *COMPARISONS)):
                    end += 1
                pattern = nodes[i + 1 : end]
                out.append(n)
                if end < len(nodes) and nodes[end].up == "ESCAPE":
                    out += self.expr(pattern, scope.value(), ctes)
                elif len(pattern) == 1 and pattern[0].kind == "string":
                    out.append(raw(literal(value_of(pattern[0]).replace("\\", "\\\\"))))
                else:
                    out.append(raw(f"replace({show(self.expr(pattern, scope.value(), ctes))}, {literal(chr(92))}, {literal(chr(92) * 2)})"))
                i = end - 1
            elif n.up == "CASE":
                end, depth = i + 1, 1
                while depth:
                    depth += {"CASE": 1, "END": -1}.get(nodes[end].up, 0)
                    end += 1
                out.append(raw(show([n, *self.expr(nodes[i + 1 : end - 1], scope.value(), ctes), nodes[end - 1]])))
                i = end - 1
            else:
                out.append(n)
            i += 1
        out = self.casts(out, scope)
        out = self.membership(out, scope, ctes)
        return self.division(out, scope)

    def items(self, nodes: list, scope: Scope, ctes: str) -> list:
        made = []
        for i, part in enumerate(split(nodes)):
            made += ([Tok("op", ",")] if i else []) + self.expr(part, scope, ctes)
        return made

    def window(self, g: Group, scope: Scope, ctes: str) -> Group:
        at = next((i for i, n in enumerate(g.items) if n.up == "ORDER"), None)
        if at is None:
            return Group(self.items(g.items, scope, ctes))
        end = next((i for i, n in enumerate(g.items) if i > at and n.up in ("ROWS", "RANGE", "GROUPS")), len(g.items))
        items: list = []
        for part in split(g.items[at + 2 : end]):
            items += ([Tok("op", ",")] if items else []) + self.order_item(part, scope, ctes)
        return Group([*self.items(g.items[:at], scope, ctes), *g.items[at : at + 2], *items, *g.items[end:]])

    def call(self, name: Tok, g: Group, over: object, scope: Scope, ctes: str, chosen: list) -> list:
        f = name.text.lower()
        nulls = next((i for i, n in enumerate(g.items) if n.up in ("IGNORE", "RESPECT") and i + 1 < len(g.items) and g.items[i + 1].up == "NULLS"), None)
        if nulls is not None and over is not None:  # Spark says it behind the call
            said, g = g.items[nulls : nulls + 2], Group([*g.items[:nulls], *g.items[nulls + 2 :]])
            return [raw(f"{show(self.call(name, g, None, scope, ctes, chosen))} {show([*said, Tok('word', 'OVER'), over])}")]
        if over is not None and chosen and f in AGGREGATES:  # windows have no FILTER: what it leaves out is NULL
            some = f"({show(chosen[1].items[1:])})"  # behind WHERE
            argument = [raw(f"CASE WHEN {some} THEN {show(self.expr(g.items, scope, ctes)) if f != 'count_star' and show(g.items) not in ('', '*') else 1} END")]
            name, g, chosen, f = (Tok("word", "count") if f == "count_star" else name), Group(argument), [], "count" if f == "count_star" else f
        if isinstance(over, Group) and not over.items and f in AGGREGATES and scope.everything:
            # over all rows: an aggregate of its own, in parallel, in place of a window in one task
            return [raw(f"(SELECT {show(self.call(name, g, None, Scope(scope.types, True), ctes, chosen))} {scope.everything})")]
        tail = [*chosen, *([] if over is None else [Tok("word", "OVER"), over])]
        if f in ("cast", "try_cast"):
            at = max(i for i, n in enumerate(g.items) if n.up == "AS")
            return [raw(self.cast(show(self.expr(g.items[:at], scope.value(), ctes)), show(g.items[at + 1 :]), scope, name.text.upper()))]
        if f == "extract":
            at = next(i for i, n in enumerate(g.items) if n.up == "FROM")
            return [raw(extract(show(g.items[:at]).strip("'"), show(self.expr(g.items[at + 1 :], scope.value(), ctes))))]
        if f in ("substring", "substr") and any(n.up == "FROM" for n in g.items):
            words, parts = {"FROM": 1, "FOR": 2}, [[], [], []]
            k = 0
            for n in g.items:
                k = words.get(n.up, k) if n.up in words else k
                if n.up not in words:
                    parts[k].append(n)
            args = [show(self.expr(p, scope.value(), ctes)) for p in parts if p]
        else:
            distinct = [g.items[0]] if g.items and g.items[0].up == "DISTINCT" else []
            args = [show(self.expr(p, scope.value(), ctes)) for p in split(g.items[len(distinct) :]) if p]
            if f in ("sum", "avg") and len(args) == 1:
                return [raw(aggregate(f, args[0], self.known(args[0], scope), "DISTINCT " if distinct else "", show(tail)))]
            if distinct:
                return [name, Group([*distinct, raw(", ".join(args))]), *tail]
        if f in ("rank", "dense_rank", "row_number", "ntile"):
            ordered = isinstance(over, Group) and any(n.up == "ORDER" for n in over.items) or isinstance(over, Tok)
            if f == "rank" and not ordered:
                return [raw("CAST(1 AS BIGINT)")]
            return [raw(f"CAST({f}({', '.join(args)}) {show(tail)} AS BIGINT)")]
        made = FUNCTIONS[f](args) if f in FUNCTIONS else None
        if made is not None:
            return [raw(f"{made} {show(tail)}".strip())]
        return [name, Group([raw(", ".join(args))] if args else []), *tail]

    def cast(self, value: str, kind: str, scope: Scope, how: str = "CAST") -> str:
        spark = re.sub(r"^\w+", lambda m: TYPES.get(m[0].upper(), m[0].upper()), kind.strip())
        if spark.split("(")[0] in ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"):
            of = self.known(value, scope)
            if of.startswith("decimal"):
                value = f"round({value}, 0)"
            elif of in ("double", "float"):
                value = f"bround({value}, 0)"
        return f"{how}({value} AS {spark})"

    def casts(self, nodes: list, scope: Scope) -> list:
        """x::T, which binds tighter than anything else."""
        out: list = []
        i = 0
        while i < len(nodes):
            if nodes[i].text == "::" if isinstance(nodes[i], Tok) and nodes[i].kind == "op" else False:
                start = self.primary_start(out)
                kind = [nodes[i + 1]]
                i += 1
                if i + 1 < len(nodes) and isinstance(nodes[i + 1], Group):
                    i += 1
                    kind.append(nodes[i])
                value = show(out[start:])
                del out[start:]
                out.append(raw(self.cast(value, show(kind), scope)))
            else:
                out.append(nodes[i])
            i += 1
        return out

    @staticmethod
    def primary_start(out: list) -> int:
        """Where the last operand of out begins: a.b.c, f(x), f(x) OVER (..), a literal or a group."""
        i = len(out) - 1
        if isinstance(out[i], Group) and i and out[i - 1].up == "OVER":
            i -= 2
        if isinstance(out[i], Group) and i and out[i - 1].kind == "word" and out[i - 1].up not in STOP:
            i -= 1
        while i >= 2 and out[i - 1].kind == "op" and out[i - 1].text == ".":
            i -= 2
        if i and out[i].kind == "string" and out[i - 1].up in ("DATE", "INTERVAL"):
            i -= 1
        return i

    @staticmethod
    def operand_start(out: list) -> int:
        """Where the operand of a comparison that ends out begins."""
        start = len(out)
        while start and out[start - 1].up not in STOP and not (out[start - 1].kind == "op" and out[start - 1].text in (",", *COMPARISONS)):
            start -= 1
        return start

    def membership(self, nodes: list, scope: Scope, ctes: str) -> list:
        out: list = []
        i = 0
        while i < len(nodes):
            n = nodes[i]
            if n.kind == "op" and n.text in COMPARISONS and i + 2 < len(nodes) and nodes[i + 1].up in ("ANY", "SOME", "ALL") and is_query(nodes[i + 2]):
                inside = n.text == "=" and nodes[i + 1].up != "ALL"
                outside = n.text in ("<>", "!=") and nodes[i + 1].up == "ALL"
                if not inside and not outside:
                    start = self.operand_start(out)
                    x = show(out[start:])
                    del out[start:]
                    out.append(raw(quantified(x, n.text, nodes[i + 1].up, show(nodes[i + 2].items))))
                    i += 3
                    continue
                out += ([] if inside else [Tok("word", "NOT")]) + [Tok("word", "IN"), nodes[i + 2]]
                i += 3
                continue
            out.append(n)
            i += 1
        if scope.where and not any(n.up in ("OR", "BETWEEN") for n in out):
            out = self.anti_joined(out, ctes)
        free = scope.rows and scope.where  # NOT IN elsewhere in a WHERE clause is looked at as a value, for its plan's sake
        if not (scope.mark or free) or not any(n.up == "IN" and i + 1 < len(out) and is_query(out[i + 1]) for i, n in enumerate(out)):
            return out
        nodes, out, i = out, [], 0
        while i < len(nodes):
            n = nodes[i]
            if n.up == "IN" and i + 1 < len(nodes) and is_query(nodes[i + 1]):
                negated = bool(out) and out[-1].up == "NOT"
                if negated:
                    out.pop()
                start = self.operand_start(out)
                if not scope.mark and not negated:  # a semi join by itself
                    out += nodes[i : i + 2]
                    i += 2
                    continue
                x, q = show(out[start:]), show([nodes[i + 1]])
                several = len(out) - start == 1 and isinstance(out[start], Group) and len(split(out[start].items)) > 1
                del out[start:]
                yes, no = ("false", "true") if negated else ("true", "false")
                if scope.rows and not several and self.analyse(f"{ctes} {q[1:-1]}".strip()):
                    out.append(raw(f"(CASE WHEN {facts(q)} = 0 THEN {no} WHEN {met(x, q)} THEN {yes} WHEN ({x}) IS NULL OR {facts(q)} = 2 THEN NULL ELSE {no} END)"))
                elif scope.mark:
                    out.append(raw(f"(CASE WHEN {x} IN {q} THEN {yes} WHEN {x} NOT IN {q} THEN {no} END)"))
                else:
                    out.append(raw(f"{x} NOT IN {q}"))
                i += 2
                continue
            out.append(n)
            i += 1
        return out

    def anti_joined(self, nodes: list, ctes: str) -> list:
        """x NOT IN (q) among conditions that must all hold, for a q of its own: an anti join on equal keys and facts about q.

        Spark's own null-aware join takes all of q to every task.
        """
        out: list = []
        for i, part in enumerate(split_words(nodes, "AND")):
            out += [Tok("word", "AND")] if i else []
            if len(part) > 3 and part[-3].up == "NOT" and part[-2].up == "IN" and is_query(part[-1]) and not any(n.up in STOP or n.kind == "op" and n.text in COMPARISONS for n in part[:-3]) and not (len(part) == 4 and isinstance(part[0], Group) and len(split(part[0].items)) > 1):
                x, q = show(part[:-3]), show(part[-1:])
                if self.analyse(f"{ctes} {q[1:-1]}".strip()):
                    part = [raw(f"(NOT {met(x, q)}) AND ({facts(q)} = 0 OR {facts(q)} = 1 AND ({x}) IS NOT NULL)")]
            out += part
        return out

    def division(self, nodes: list, scope: Scope) -> list:
        """Multiplicative chains with / or //, left to right."""
        if not any(n.kind == "op" and n.text in ("/", "//") for n in nodes):
            return nodes
        out: list = []
        i = 0
        while i < len(nodes):
            end = self.operand_end(nodes, i)
            if end == i:
                out.append(nodes[i])
                i += 1
                continue
            left, i = nodes[i:end], end
            while i < len(nodes) and nodes[i].kind == "op" and nodes[i].text in ("*", "/", "//", "%"):
                op = nodes[i].text
                sign = i + 1 < len(nodes) and nodes[i + 1].kind == "op" and nodes[i + 1].text in "+-"
                end = self.operand_end(nodes, i + 1 + sign)
                if end == i + 1 + sign:
                    break
                right = nodes[i + 1 : end]
                if op == "/":
                    left = [raw(divide(show(left), show(right)))]
                elif op == "//":
                    a, b = show(left), show(right)
                    whole = all(t in INTEGRAL or not t for t in (self.known(a, scope), self.known(b, scope)))
                    left = [raw(f"(({a}) div ({b}))" if whole else f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))")]
                else:
                    left = [*left, nodes[i], *right]
                i = end
            out += left
        return out

    @staticmethod
    def operand_end(nodes: list, i: int) -> int:
        """Behind the operand that begins at i, or i where none does."""
        if i >= len(nodes):
            return i
        n = nodes[i]
        if n.kind == "op" or n.up in STOP:
            return i
        if n.up in ("DATE", "INTERVAL", "TIMESTAMP") and i + 1 < len(nodes) and nodes[i + 1].kind == "string":
            return i + 2
        i += 1
        while i + 1 < len(nodes) and nodes[i].kind == "op" and nodes[i].text == ".":
            i += 2
        if i < len(nodes) and isinstance(nodes[i], Group) and n.kind == "word":
            i += 1
        if i + 1 < len(nodes) and nodes[i].up == "OVER":
            i += 2
        return i


def split_words(nodes: list, word: str) -> list[list]:
    parts: list[list] = [[]]
    for n in nodes:
        if n.up == word:
            parts.append([])
        else:
            parts[-1].append(n)
    return parts


def facts(q: str) -> str:
    """Of a subquery in parentheses: 0 without rows, 2 with a NULL, else 1.  Equal subqueries run once."""
    return f"(SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(*) = count(`__v`) THEN 1 ELSE 2 END FROM {q} AS `__q`(`__v`))"


def met(x: str, q: str) -> str:
    """Whether x is among a subquery's values: a join on equal keys, whatever its size."""
    return f"EXISTS (SELECT 1 FROM {q} AS `__q`(`__v`) WHERE `__q`.`__v` = {x})"


def numbered(names: list[str]) -> list[str]:
    """Names with a number behind those that came before: a, a_1, a_2."""
    out: list[str] = []
    for n in names:
        name, k = n, 0
        while name.lower() in (x.lower() for x in out):
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


# -- functions ----------------------------------------------------------------------------------------------------


def divide(a: str, b: str) -> str:
    """DOUBLE division with IEEE results for zero divisors."""
    if re.fullmatch(r"[\d.]+", b) and float(b):
        return f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"(CASE WHEN {y} = 0 THEN CASE WHEN {x} = 0 OR isnan({x}) THEN CAST('NaN' AS DOUBLE) WHEN {x} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {x} < 0 THEN CAST('-Infinity' AS DOUBLE) END ELSE {x} / {y} END)"


def exact_sum(arg: str, of: str, over: str = "") -> str:
    """A sum of integers in 38 digits from BIGINT sums of their parts, which stay in range for 2^41 rows and more.

    A decimal sum would make an object for every row.
    """
    x = f"CAST({arg} AS BIGINT)"
    bits = 21 if of == "bigint" else 16
    low = (1 << bits) - 1
    parts = [(f"shiftright({x}, {2 * bits})", 1 << 2 * bits), (f"(shiftright({x}, {bits}) & {low})", 1 << bits), (f"({x} & {low})", 1)] if of == "bigint" else [(f"shiftright({x}, {bits})", 1 << bits), (f"({x} & {low})", 1)]
    terms = " + ".join(f"CAST(sum({part}) {over} AS DECIMAL(38,0)) * CAST({unit} AS DECIMAL(14,0))" for part, unit in parts)
    return f"CAST({terms} AS DECIMAL(38,0))"


def quantified(x: str, op: str, how: str, q: str) -> str:
    """x < ANY (q) and its like, three-valued: an extreme of q decides, unless q has NULLs."""
    if op in ("=", "<>", "!="):
        one = f"(SELECT min(v) FROM ({q}) AS q(v))", f"(SELECT max(v) FROM ({q}) AS q(v))"
        best = f"({x} {op} {one[0]} {'OR' if how != 'ALL' else 'AND'} {x} {op} {one[1]})"
        if op == "=" and how != "ALL":
            return f"({x} IN ({q}))"
    else:
        f = "max" if (op in ("<", "<=")) == (how != "ALL") else "min"
        best = f"({x} {op} (SELECT {f}(v) FROM ({q}) AS q(v)))"
    rows, nulls = f"(SELECT count(*) FROM ({q}) AS q(v))", f"(SELECT count(*) - count(v) FROM ({q}) AS q(v))"
    sure = "" if how == "ALL" else "NOT "
    empty = "true" if how == "ALL" else "false"
    return f"(CASE WHEN {rows} = 0 THEN {empty} WHEN {nulls} = 0 THEN {best} WHEN {'NOT ' if not sure else ''}{best} THEN {'false' if not sure else 'true'} END)"


def aggregate(f: str, arg: str, of: str, distinct: str, over: str) -> str:
    """Sums of integers and decimals are exact in 38 digits; averages are DOUBLE, those of times a time."""
    if f == "sum":
        if of in INTEGRAL and not distinct:
            return exact_sum(arg, of, over)
        if of in INTEGRAL:
            arg = f"CAST({arg} AS DECIMAL(38,0))"
        elif m := re.fullmatch(r"decimal\((\d+),(\d+)\)", of):
            arg = f"CAST({arg} AS DECIMAL(38,{m[2]}))"
            return f"CAST(sum({distinct}{arg}) {over} AS DECIMAL(38,{m[2]}))"
        return f"sum({distinct}{arg}) {over}".strip()
    if of.startswith("decimal"):
        arg = f"CAST({arg} AS DOUBLE)"
    elif of in ("date", "timestamp", "timestamp_ntz"):
        return f"CAST(timestamp_micros(CAST(avg({distinct}unix_micros(CAST({arg} AS TIMESTAMP))) {over} AS BIGINT)) AS TIMESTAMP_NTZ)"
    return f"avg({distinct}{arg}) {over}".strip()


def substring(args: list[str]) -> str:
    """Code points start .. start + length of a string that is numbered from 1; negative starts count from its end."""
    s, a = args[0], args[1]
    if len(args) == 2:
        return f"substring({s}, {a})" if re.fullmatch(r"[1-9]\d*", a) else f"substring({s}, CASE WHEN {a} < -char_length({s}) THEN 1 ELSE {a} END)"
    n = args[2]
    if re.fullmatch(r"[1-9]\d*", a) and re.fullmatch(r"\d+", n):
        return f"substring({s}, {a}, {n})"
    first = f"(CASE WHEN {a} < 0 THEN char_length({s}) + {a} + 1 ELSE {a} END)"
    low, high = f"greatest(least({first}, {first} + {n}), 1)", f"least(greatest({first}, {first} + {n}), char_length({s}) + 1)"
    return f"(CASE WHEN {s} IS NULL OR {a} IS NULL OR {n} IS NULL THEN NULL WHEN {high} > {low} THEN substring({s}, CAST({low} AS INT), CAST({high} - {low} AS INT)) ELSE '' END)"


def _text(lit: str) -> str:
    return re.sub(r"\\(.)", r"\1", lit[1:-1])


def regexp_replace(args: list[str]) -> str:
    """The first match only, unless 'g' is given; \\1 to \\9 are groups and \\0 is the match.  Pattern and replacement may be computed."""
    options = _text(args[3]) if len(args) == 4 and args[3].startswith("'") else ""
    if len(args) not in (3, 4) or len(args) == 4 and not args[3].startswith("'") or set(options) - set("gisc"):
        raise DialectError("regexp_replace takes a text, a pattern, a replacement and options of g, i, s and c")
    # behind the text before the match, whose group is 1, the match is group 2
    shift = 0 if "g" in options else 2
    flags = "".join(f for f in "is" if f in options)
    before, after = ("", "") if shift == 0 else ("^([\\s\\S]*?)(", ")")
    before = (f"(?{flags})" if flags else "") + before
    if args[1].startswith("'"):
        pattern = literal(before + _text(args[1]) + after)
    else:
        pattern = f"concat({literal(before)}, {args[1]}, {literal(after)})" if before or after else args[1]
    if args[2].startswith("'"):
        to = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + shift}", _text(args[2]).replace("$", "\\$"))
        to = literal(to if shift == 0 else "$1" + to)
    else:
        to = f"replace({args[2]}, '$', {literal(chr(92) + '$')})"
        for k in range(10):
            to = f"replace({to}, {literal(chr(92) + str(k))}, '${k + shift}')"
        to = to if shift == 0 else f"concat('$1', {to})"
    return f"regexp_replace({args[0]}, {pattern}, {to})"


def simple_case(f: str, x: str, special: dict[str, str]) -> str:
    """Upper or lower case that maps every character to one: texts with special characters go one by one."""
    of, to = "".join(special), "".join(special.values())
    each = f"CASE WHEN contains({literal(of)}, c) THEN translate(c, {literal(of)}, {literal(to)}) ELSE {f}(c) END"
    return f"(CASE WHEN {x} RLIKE {literal('[' + of + ']')} THEN array_join(transform(regexp_extract_all({x}, '(?s).', 0), c -> {each}), '') ELSE {f}({x}) END)"


def extract(unit: str, x: str) -> str:
    """A field of a date or time, BIGINT (epoch: DOUBLE)."""
    u = unit.lower().rstrip("s") if unit.lower() not in ("s",) else "second"
    u = {"y": "year", "yr": "year", "mon": "month", "d": "day", "dayofmonth": "day", "h": "hour", "hr": "hour", "m": "minute", "min": "minute", "sec": "second", "m": "minute", "w": "week", "weekofyear": "week", "dayofweek": "dow", "weekday": "dow", "dayofyear": "doy", "msec": "millisecond", "millisecond": "millisecond", "usec": "microsecond", "microsecond": "microsecond", "quarter": "quarter", "centurie": "century", "millennium": "millennium", "millennia": "millennium", "yearweek": "yearweek"}.get(u, u)
    long = lambda e: f"CAST({e} AS BIGINT)"
    ts = f"CAST({x} AS TIMESTAMP_NTZ)"
    year = f"year({x})"
    made = {
        "dow": f"dayofweek({x}) - 1",
        "isodow": f"extract(DAYOFWEEK_ISO FROM {x})",
        "isoyear": f"extract(YEAROFWEEK FROM {x})",
        "doy": f"dayofyear({x})",
        "week": f"weekofyear({x})",
        "decade": f"floor({year} / 10)",
        "century": f"floor(({year} - 1) / 100) + 1",
        "millennium": f"floor(({year} - 1) / 1000) + 1",
        "second": f"floor(extract(SECOND FROM {ts}))",
        "millisecond": f"floor(extract(SECOND FROM {ts}) * 1000)",
        "microsecond": f"floor(extract(SECOND FROM {ts}) * 1000000)",
        "hour": f"hour({ts})",
        "minute": f"minute({ts})",
    }
    if u == "epoch":
        return f"(unix_micros(CAST({x} AS TIMESTAMP)) / 1000000D)"
    return long(made.get(u, f"extract({u.upper()} FROM {x})"))


def date_trunc(args: list[str]) -> str:
    unit, x = _text(args[0]).lower(), args[1]
    if unit in ("decade", "century", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[unit]
        return f"make_timestamp_ntz(CAST(floor(year({x}) / {n}) * {n} AS INT), 1, 1, 0, 0, 0)"
    return f"CAST(date_trunc('{unit}', CAST({x} AS TIMESTAMP)) AS TIMESTAMP_NTZ)"


def grouping(args: list[str]) -> str:
    return "(" + " + ".join(f"CAST(grouping({a}) AS BIGINT) * {1 << (len(args) - 1 - i)}" for i, a in enumerate(args)) + ")"


FUNCTIONS: dict[str, Callable[[list[str]], str | None]] = {
    "strlen": lambda a: f"CAST(octet_length({a[0]}) AS BIGINT)",
    "substring": substring,
    "substr": substring,
    "regexp_replace": regexp_replace,
    "concat": lambda a: f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in a)})",
    "upper": lambda a: simple_case("upper", a[0], UPPER),
    "ucase": lambda a: simple_case("upper", a[0], UPPER),
    "lower": lambda a: simple_case("lower", a[0], LOWER),
    "lcase": lambda a: simple_case("lower", a[0], LOWER),
    "date_trunc": date_trunc,
    "date_part": lambda a: extract(_text(a[0]), a[1]),
    "datepart": lambda a: extract(_text(a[0]), a[1]),
    "todatetime": lambda a: f"CAST(timestamp_seconds({a[0]}) AS TIMESTAMP_NTZ)",
    "epoch_ms": lambda a: f"CAST(timestamp_millis({a[0]}) AS TIMESTAMP_NTZ)",
    "grouping": lambda a: grouping(a),
    "grouping_id": lambda a: grouping(a) if a else "CAST(grouping_id() AS BIGINT)",
    "count_star": lambda a: "count(*)",
}
