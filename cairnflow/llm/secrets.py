"""Secret scans in native DataFrame functions: patterns, and sliding-window Shannon entropy.

Base kinds are patterns.  The method adds spans: candidate strings (long runs of token
characters) belong to a character class: hexadecimal of one or both cases, base64, or digits
with letters of one case; a window slides over each,
its character counts, packed into seven longs, are updated by the one that enters and the one
that leaves, and with them the sum of c * log2(c), so the window's entropy costs the same at
every step.  Windows
at or above the class's threshold are joined to spans.  Candidates on the allow-list are
suppressed, and so are windows that hold a placeholder, and entropy spans that a base span covers.

Everything is one projection over the input: no shuffle, no Python.  Positions are code
points, end exclusive.  Running values (positions, ends covered so far) are made in blocks, so
a text with very many matches takes time nearly in proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER_MARK = "\x01", "\x02"
#: Array elements that are gone through together; even, so that blocks of a split text begin outside of matches.
BLOCK = 256
#: Counts of a window are packed five bits each, twelve to a long, from the first character on.
FIRST, PACKED, BITS = ord("+"), 12, 5
LONGS = (ord("z") - FIRST) // PACKED + 1

#: (kind, pattern, group whose length counts or 0 for the match, least length), in the order of ties.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a run of 32 or more is what a run of any length, then held to 32, gives
)
#: Words of made-up values.  No candidate holds one whole, so just the windows around it are left out.
PLACEHOLDER = r"(?i:example|sample|placeholder|changeme|dummy|xxxx|0000)"
TOKEN = "[A-Za-z0-9+/_-]"
#: An equals sign ends a candidate, as padding or before a value.  Enough token characters are
#: looked for first, as placeholders take long to rule out.
CANDIDATE = rf"(?={TOKEN}{{24}})(?:(?!{PLACEHOLDER}){TOKEN}){{24,}}+={{0,2}}"
#: (kind, whole-string pattern, window, least bits a character); the first class that fits counts.
CLASSES = (
    ("entropy_hex", r"^(?:[0-9a-f]+|[0-9A-F]+)={0,2}$", 24, 3.0),
    ("entropy_mixed_hex", r"^[0-9a-fA-F]+={0,2}$", 24, 3.3),
    ("entropy_base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 24, 3.9),
    ("entropy_lower", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=-]+$", 24, 3.7),
    ("entropy_upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9+/_=-]+$", 24, 3.6),
)
#: Candidates that fit one of these are no secrets: identifiers in UUID form, plain numbers, words joined by hyphens or slashes.
ALLOW = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9=_-]+$",
    r"^[A-Za-z]+(?:[/_-]+[A-Za-z]+)*$",
)
SPAN = "struct<start:int,end:int,text:string>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(xs: Column) -> Column:
    """The array, a bound one, in blocks of BLOCK elements."""
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))


def running(xs: Column, of: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """array<struct<x, before>>: each element with the ``join``, an associative one that starts from 0, of what ``of`` gives for those before it.

    An array that grows is copied at each step, so only blocks and their list grow.
    """
    return bound(xs, lambda held: bound(blocks(held), lambda cut: running_blocks(cut, of, join)))


def running_blocks(cut: Column, of: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    zero, none = F.lit(0), F.array()
    totals = F.transform(cut, lambda b: F.aggregate(b, zero, lambda s, x: join(s, of(x))))
    first = F.struct(zero.alias("s"), none.cast("array<int>").alias("out"))
    offsets = F.aggregate(totals, first, lambda a, t: F.struct(join(a["s"], t).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])

    def within(z: Column) -> Column:
        begin = F.struct(z["offset"].alias("s"), none.cast("array<int>").alias("out"))
        befores = F.aggregate(z["block"], begin, lambda a, x: F.struct(join(a["s"], of(x)).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])
        return F.arrays_zip(z["block"].alias("x"), befores.alias("before"))

    return F.flatten(F.transform(F.arrays_zip(cut.alias("block"), offsets.alias("offset")), within))


def hits(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches.

    Matches are put between marks, so every second part is one; a mark in the text itself was
    replaced before by another character that no pattern holds either.
    """
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    placed = running(parts, F.length, lambda s, n: s + n)
    inside = F.filter(placed, lambda p, k: k % 2 == 1)
    return F.transform(inside, lambda p: F.struct(p["before"].alias("start"), (p["before"] + F.length(p["x"])).alias("end"), p["x"].alias("text")))


def hot_windows(candidate: Column, window: int, least_bits: float) -> Column:
    """array<struct<start, end>> in the candidate: windows of at least ``least_bits`` a character, joined where they meet."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST)
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    pairs = F.filter(F.arrays_zip(codes.alias("enter"), leaving.alias("leave")), lambda p: p["enter"] >= 0)
    spans = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("sum"), spans.alias("spans"))

    def xlog(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def place(code: Column) -> tuple[Column, Column]:
        """Which long, and the shift in it."""
        return F.floor(code / PACKED).cast("int"), (code % PACKED * BITS).cast("int")

    def shifted(value: Column, by: Column, left: bool) -> Column:
        return F.call_function("shiftleft" if left else "shiftright", value, by)

    def step(s: Column, p: Column) -> Column:
        enter, leave = p["enter"], p["leave"]
        same = enter == leave
        (k_in, b_in), (k_out, b_out) = place(enter), place(F.greatest(leave, F.lit(0)))
        count = lambda k, b: shifted(F.get(s["counts"], k), b, False).bitwiseAND((1 << BITS) - 1)
        c_in, c_out = count(k_in, b_in), count(k_out, b_out)
        gone = F.when((leave < 0) | same, F.lit(0.0)).otherwise(xlog(c_out - 1) - xlog(c_out))
        total = s["sum"] + F.when(same, F.lit(0.0)).otherwise(xlog(c_in + 1) - xlog(c_in)) + gone
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        moved = F.transform(s["counts"], lambda v, k: v + F.when(k == k_in, shifted(one, b_in, True)).otherwise(none) - F.when((k == k_out) & (leave >= 0), shifted(one, b_out, True)).otherwise(none))
        counts = F.when(same, s["counts"]).otherwise(moved)
        n = s["n"] + 1
        bits = F.lit(log2(window)) - total / window
        hot = (n >= window) & (bits >= least_bits - 1e-9)
        last = F.try_element_at(s["spans"], F.lit(-1))
        joins = last.isNotNull() & (last["end"] >= n - window)
        grown = F.concat(
            F.when(joins, F.slice(s["spans"], 1, F.size(s["spans"]) - 1)).otherwise(s["spans"]),
            F.array(F.struct(F.when(joins, last["start"]).otherwise(n - window).cast("int").alias("start"), n.cast("int").alias("end"))),
        )
        return F.struct(n.alias("n"), counts.alias("counts"), total.alias("sum"), F.when(hot, grown).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(pairs, first, step, lambda s: s["spans"])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it, in either case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scan(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW, to: str = "secrets") -> DataFrame:
    """``docs`` with one more column, ``to``: array<struct<start:int, order:int, end:int, kind:string>>.

    Sorted by start, then by kind in the order BASE, CLASSES.  A null or empty text has no
    spans.  ``allow`` are patterns that suppress entropy candidates; base spans stay.  Rows
    are independent: nulls, repeats and other columns pass through (a column named ``to`` is
    replaced); an empty table gives an empty result.  A text of any length is scanned whole.
    """
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(OTHER_MARK))
    kinds = [k for k, *_ in BASE] + [k for k, *_ in CLASSES]

    def span(h: Column, k: int, offset: Column | None = None) -> Column:
        at = F.lit(0) if offset is None else offset
        return F.struct((h["start"] + at).alias("start"), F.lit(k).alias("order"), (h["end"] + at).alias("end"), F.lit(kinds[k]).alias("kind"))

    def base(k: int) -> Column:
        _, pattern, group, least = BASE[k]
        measured = (lambda h: F.regexp_extract(h["text"], pattern, group)) if group else (lambda h: h["text"])
        kept = F.filter(hits(text, pattern), lambda h: F.length(measured(h)) >= least)
        return F.transform(kept, lambda h: span(h, k))

    held = free_name(docs, "candidates")
    marked = docs.withColumns({to: F.concat(*map(base, range(len(BASE)))), held: hits(text, CANDIDATE)})

    def suppressed(c: Column) -> Column:
        out = F.lit(False)
        for pattern in allow:
            out = out | c["text"].rlike(pattern)
        return out

    def windows(c: Column) -> Column:
        out = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
        for k in reversed(range(len(CLASSES))):
            out = F.when(c["text"].rlike(CLASSES[k][1]), in_class(c, k)).otherwise(out)
        return out

    def in_class(c: Column, k: int) -> Column:
        _, _, window, bits = CLASSES[k]
        return F.transform(hot_windows(c["text"], window, bits), lambda h: span(h, len(BASE) + k, c["start"]))

    hot = F.flatten(F.transform(F.filter(held, lambda c: ~suppressed(c)), windows))
    # in order, a base span that covers an entropy span comes before it, so the furthest end of base spans so far tells
    ends = running(F.array_sort(F.concat(to, hot)), lambda h: F.when(h["order"] < len(BASE), h["end"]).otherwise(0), F.greatest)
    kept = F.filter(ends, lambda r: (r["x"]["order"] < len(BASE)) | (r["before"] < r["x"]["end"]))
    return marked.withColumn(to, F.transform(kept, lambda r: r["x"])).drop(held)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex, base_sha256 and spans, as :func:`scan` finds them."""
    rows = scan(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    base = F.filter("secrets", lambda s: s["order"] < len(BASE))

    def count(k: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["order"] == k)).cast("long").alias(f"n_{BASE[k][0]}")

    counts = map(count, range(len(BASE)))
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by ``[kind]``; where spans overlap, the first in order stands for all.

    Rows without spans, and null texts, are left as they are; no row and no other column,
    whatever its name, is dropped; long texts are as in :func:`scan`.
    """
    found = free_name(docs, "secrets")
    rows = scan(docs, text_col, to=found)
    text = F.col(text_col)
    placed = F.filter(running(F.col(found), lambda h: h["end"], F.greatest), lambda r: r["x"]["start"] >= r["before"])

    def replaced(block: Column) -> Column:
        """The text from the first gap of a block to its last span, cut out once, with the kinds in place of spans."""
        begin, end = F.element_at(block, 1)["before"], F.element_at(block, -1)["x"]["start"]
        pieces = lambda local: F.transform(block, lambda r: F.concat(F.substring(local, r["before"] - begin + 1, r["x"]["start"] - r["before"]), F.lit("["), r["x"]["kind"], F.lit("]")))
        return F.array_join(bound(F.substring(text, begin + 1, end - begin), pieces), "")

    last = F.array_max(F.transform(found, lambda h: h["end"]))
    clean = F.concat(F.array_join(bound(placed, lambda p: F.transform(blocks(p), replaced)), ""), F.substring(text, last + 1, F.length(text)))
    return rows.withColumn(text_col, F.when(F.size(found) > 0, clean).otherwise(text)).drop(found)
