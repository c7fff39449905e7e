"""Column helpers that give the DataFrame API the same answers as the SQL text: pure expressions, no UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HUGEINT = "decimal(38,0)"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_int(x: Column | str) -> Column:
    """Exact sum of integers (64 bits at most) in 38 digits, from sums of their parts: no decimal is made for a row."""
    x = _col(x).cast("bigint")
    bits, low = 21, (1 << 21) - 1
    parts = ((F.shiftright(x, 2 * bits), 1 << 2 * bits), (F.shiftright(x, bits).bitwiseAND(F.lit(low)), 1 << bits), (x.bitwiseAND(F.lit(low)), 1))
    high, middle, rest = (F.sum(p).cast(HUGEINT) * F.lit(str(unit)).cast("decimal(14,0)") for p, unit in parts)
    return (high + middle + rest).cast(HUGEINT)


def sum_dec(x: Column | str, scale: int) -> Column:
    """Exact sum of decimals, DECIMAL(38, scale)."""
    return F.sum(_col(x).cast(f"decimal(38,{scale})")).cast(f"decimal(38,{scale})")


def avg_num(x: Column | str) -> Column:
    """Average of any number as DOUBLE."""
    return F.avg(_col(x).cast("double"))


def avg_time(x: Column | str) -> Column:
    """Average of dates or times as TIMESTAMP_NTZ (session time zone UTC)."""
    return F.timestamp_micros(F.avg(F.unix_micros(_col(x).cast("timestamp"))).cast("long")).cast("timestamp_ntz")


def div(a: Column | str, b: Column | str) -> Column:
    """DOUBLE division: x / 0 is an infinity with x's sign, 0 / 0 NaN."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    return F.when(y == 0, zero).otherwise(x / F.when(y != 0, y))


def idiv(a: Column | str, b: Column | str, to: str = "bigint") -> Column:
    """Integer division towards zero; a zero divisor is an error."""
    x, y = _col(a), _col(b)
    return ((x - x % y) / y).cast(to)


def fmod(a: Column | str, b: Column | str) -> Column:
    """Remainder of doubles with the dividend's sign; NaN for a zero divisor."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    return F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y != 0, y))


def substr(s: Column | str, start: Column | int, length: Column | int | None = None) -> Column:
    """Code points start .. start + length; start 0 is before the first, negative starts count from the end."""
    s = _col(s)
    n = F.char_length(s)
    a = F.lit(start) if isinstance(start, int) else start
    first = F.when(a < 0, n + a + 1).otherwise(a)
    if length is None:
        low = F.greatest(first, F.lit(1))
        return F.when(s.isNull() | a.isNull(), None).when(n + 1 > low, F.substring(s, low.cast("int"), n)).otherwise("")
    size = F.lit(length) if isinstance(length, int) else length
    low = F.greatest(F.least(first, first + size), F.lit(1))
    high = F.least(F.greatest(first, first + size), n + 1)
    return F.when(s.isNull() | a.isNull() | size.isNull(), None).when(high > low, F.substring(s, low.cast("int"), (high - low).cast("int"))).otherwise("")


def regexp_first(s: Column | str, pattern: str, to: str) -> Column:
    """The first match replaced; \\1 .. \\9 in ``to`` are groups."""
    shifted = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", to.replace("$", "\\$"))
    return F.regexp_replace(_col(s), f"^([\\s\\S]*?)(?:{pattern})", "$1" + shifted)


def concat_skip(*parts: Column | str) -> Column:
    """Concatenation that skips NULLs and is never NULL."""
    return F.concat_ws("", *(_col(p).cast("string") for p in parts))


def strlen(s: Column | str) -> Column:
    return F.octet_length(_col(s)).cast("long")


#: Characters whose upper case has several characters, and the single one that simple case mapping gives them.
UPPER = {c: "\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}
#: Characters whose lower case has several characters or depends on what stands around them.
LOWER = {"\u0130": "i", "\u03a3": "\u03c3"}


def _simple_case(f: Callable[[Column], Column], s: Column, special: dict[str, str]) -> Column:
    of, to = "".join(special), "".join(special.values())
    each = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.when(F.contains(F.lit(of), c), F.translate(c, of, to)).otherwise(f(c)))
    return F.when(s.rlike(f"[{of}]"), F.array_join(each, "")).otherwise(f(s))


def upper(s: Column | str) -> Column:
    """Upper case that maps every character to one."""
    return _simple_case(F.upper, _col(s), UPPER)


def lower(s: Column | str) -> Column:
    """Lower case that maps every character to one."""
    return _simple_case(F.lower, _col(s), LOWER)


def cast_int(x: Column | str, kind: str = "int", of: str = "double") -> Column:
    """Rounding casts: decimals half away from zero, doubles half to even."""
    return (F.round(_col(x), 0) if of.startswith("decimal") else F.bround(_col(x), 0)).cast(kind)


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(seconds)).cast("timestamp_ntz")


def day_number(days: Column | str) -> Column:
    """Days since 1970-01-01 as a DATE."""
    return F.date_add(F.lit("1970-01-01").cast("date"), _col(days).cast("int"))


def distinct_from(a: Column | str, b: Column | str) -> Column:
    return ~_col(a).eqNullSafe(_col(b))


def last_nulls(*keys: Column | str) -> list[Column]:
    """Sort keys, a leading - for descending, with NULLs last either way."""
    out = []
    for k in keys:
        if isinstance(k, str):
            out.append(F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last())
        else:
            out.append(k.asc_nulls_last())
    return out
