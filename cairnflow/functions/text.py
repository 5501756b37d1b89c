"""Text functions as built-in Columns, with the semantics of Python's str methods where users expect them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 29 characters that are white space to Python's str.strip and str.split, as text and as a class of a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """Without white space at either end, Unicode's included; only the ends are looked at."""
    return F.btrim(x, F.lit(SPACES))


def words(x: Column) -> Column:
    """array<string> of the runs between white space; empty for an empty text."""
    return F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "")


def word_set(x: Column) -> Column:
    return F.array_distinct(words(x))


def clean_whitespace(x: Column) -> Column:
    """Line ends to LF, runs of spaces and tabs to one space, every line stripped, empty lines dropped; in linear time."""
    flat = F.regexp_replace(F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\t[ \t]*+|  [ \t]*+| \t[ \t]*+", " ")
    lines = F.filter(F.transform(F.split(flat, "\n"), strip), lambda line: line != "")
    return F.array_join(lines, "\n")


def normalize_math(x: Column) -> Column:
    """Without dollar signs and TeX math delimiters; percent macros become percent signs."""
    out = strip(F.replace(x, F.lit("$"), F.lit("")))
    for delimiter in (r"\(", r"\)", r"\[", r"\]"):
        out = F.replace(out, F.lit(delimiter), F.lit(""))
    out = strip(out)
    for percent in (r"\percent", r"\%"):
        out = F.replace(out, F.lit(percent), F.lit("%"))
    return strip(out)


def first_nonempty(*xs: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))


def stop_truncate(x: Column, stops: list[str]) -> Column:
    """Cut at the earliest stop sequence and stripped; unchanged where there is none."""
    if not stops:
        return x
    found = F.array_min(F.filter(F.array(*(F.locate(s, x) for s in stops)), lambda p: p > 0))
    return F.when(found.isNotNull(), strip(F.substring(x, F.lit(1), found - 1))).otherwise(x)


def chatml(system: Column, user: Column) -> Column:
    """The ChatML text of a system and a user turn, open for the assistant's."""
    turn = lambda role, x: F.concat(F.lit(f"<|im_start|>{role}\n"), x, F.lit("<|im_end|>\n"))
    return F.concat(turn("system", system), turn("user", user), F.lit("<|im_start|>assistant\n"))


def fill(template: Column, name: str, value: Column) -> Column:
    """``template`` with ``{name}`` replaced by the value."""
    return F.replace(template, F.lit("{" + name + "}"), value)


def python_float(x: Column) -> Column:
    """double, or null where Python's float() would raise: underscores between digits are allowed, type suffixes aren't."""
    bare = strip(x)
    digits = r"\d+(?:_\d+)*"
    number = rf"^[+-]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?|(?i:inf|infinity|nan))$"
    return F.when(bare.rlike(number), F.regexp_replace(bare, "_", "").try_cast("double"))


def fixed(x: Column, digits: int) -> Column:
    """A double from 0 to below 128 as Python's fixed format prints it: its binary value to the nearest, ties to even."""
    bits = 46
    unit = 1 << bits
    scaled = F.floor(x * F.lit(float(unit))).cast("long") * 10**digits
    down, rest = F.shiftright(scaled, bits), scaled.bitwiseAND(unit - 1)
    up = (rest > unit // 2) | ((rest == unit // 2) & (down % 2 == 1))
    n = down + up.cast("long")
    tail = n % 10**digits
    return F.concat(((n - tail) / 10**digits).cast("long").cast("string"), F.lit("."), F.lpad(tail.cast("string"), digits, "0"))


def float_repr(x: float) -> str:
    """How Python prints a float; composed ids hold it."""
    return repr(float(x))
