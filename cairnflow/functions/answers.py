"""Answer extractors.  The four differ on purpose; a run's results depend on which made them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, first_nonempty, python_float, strip

# What counts as a number, and the opening of a boxed answer.
NUMBER = r"[-+]?\d*\.\d+|[-+]?\d+/\d+|[-+]?\d+"
BOXED = "\\boxed{"

# Fixed values, first match names the reason.
UNSAFE = [
    r"import\s+os",
    r"import\s+sys",
    r"import\s+shutil",
    r"import\s+subprocess",
    r"from\s+os",
    r"from\s+sys",
    r"from\s+subprocess",
    r"__import__",
    r"eval\(",
    r"exec\(",
    r"open\(",
]


def tagged(x: Column, tag: str, any_case: bool = False) -> Column:
    """Stripped content of the first ``<tag>…</tag>``; null without one."""
    pattern = f"(?{'i' if any_case else ''}s)<{tag}>(.*?)</{tag}>"
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1)))


def boxed_balanced(x: Column) -> Column:
    """Stripped content of the first boxed answer, braces balanced to any depth; null without one or if it never closes."""
    at = F.locate(BOXED, x)
    rest = F.substring(x, at + len(BOXED), F.length(x))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        open_ = s["depth"] > 0
        return F.struct(F.when(open_, depth).otherwise(s["depth"]).alias("depth"), (s["n"] + open_.cast("int")).alias("n"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    size = F.aggregate(F.split(rest, ""), start, step, lambda s: F.when(s["depth"] == 0, s["n"] - 1))
    return F.when(at > 0, F.when(size.isNotNull(), strip(F.substring(rest, F.lit(1), size))))


def boxed_simple(x: Column) -> Column:
    """Stripped content up to the first closing brace on the same line; null without one."""
    pattern = r"\\boxed\{([^\n]*?)\}"
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1)))


def last_number(x: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(NUMBER), 0), F.lit(-1))


def last_line(x: Column) -> Column:
    """The last line that isn't blank, stripped."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line != "")
    return F.try_element_at(lines, F.lit(-1))


def parse_response(x: Column) -> dict[str, Column]:
    """thinking, answer, reasoning_length_chars, has_xml_thinking, has_xml_answer of a response text.

    The answer: the tag in any case, else the balanced box; if that is empty, the last number
    after the thinking, else the last line there; if that is empty, the same of the whole text.
    """

    def parsed(x: Column) -> Column:
        parts = F.struct(x.alias("x"), tagged(x, "think", any_case=True).alias("think"), tagged(x, "answer", any_case=True).alias("tag"))
        return bound(parts, fields)

    def fields(p: Column) -> Column:
        x, thinking, tag = p["x"], p["think"], p["tag"]
        after = strip(F.regexp_replace(x, "(?is)^.*?<think>.*?</think>", ""))
        tail = lambda t: F.coalesce(last_number(t), last_line(t), F.lit(""))
        explicit = F.when(tag.isNotNull(), tag).otherwise(F.coalesce(boxed_balanced(x), F.lit("")))
        after_thinking = F.when(thinking.isNotNull(), bound(after, tail)).otherwise(F.lit(""))
        thought = F.coalesce(thinking, F.lit(""))
        return F.struct(
            thought.alias("thinking"),
            first_nonempty(explicit, after_thinking, tail(x)).alias("answer"),
            F.length(thought).alias("reasoning_length_chars"),
            thinking.isNotNull().alias("has_xml_thinking"),
            tag.isNotNull().alias("has_xml_answer"),
        )

    found = bound(F.coalesce(x, F.lit("")), parsed)
    return {k: found[k] for k in ("thinking", "answer", "reasoning_length_chars", "has_xml_thinking", "has_xml_answer")}


def math_answer(x: Column) -> Column:
    """The verifier's extractor: tag as written, else balanced box, else last number, else the stripped text."""
    x = F.coalesce(x, F.lit(""))
    return F.coalesce(tagged(x, "answer"), boxed_balanced(x), last_number(x), strip(x))


def provider_answer(x: Column) -> Column:
    """The provider's extractor: tag as written, else simple box, else the stripped text."""
    x = F.coalesce(x, F.lit(""))
    return F.coalesce(tagged(x, "answer"), boxed_simple(x), strip(x))


def provider_thinking(x: Column) -> Column:
    return F.coalesce(tagged(x, "think"), F.lit(""))


def code(x: Column) -> Column:
    """A fenced Python block, else any fenced block, else the answer tag, else the text; stripped."""
    x = F.coalesce(x, F.lit(""))
    out = strip(x)
    for pattern in (r"(?s)<answer>(.*?)</answer>", r"(?s)```(.*?)```", r"(?s)```python(.*?)```"):
        out = F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1))).otherwise(out)
    return out


def unsafe_pattern(x: Column) -> Column:
    """The first unsafe pattern that the code has; null without one."""
    return F.coalesce(*(F.when(x.rlike(p), F.lit(p)) for p in UNSAFE))


def math_verdict(x: Column, truth: Column, symbolic: bool = False) -> dict[str, Column]:
    """candidate, is_correct and error_message of a response against its truth.

    An empty candidate fails; with ``symbolic`` a difference that SymPy makes zero passes,
    where the library is installed; floats within 1e-5 pass; else texts are compared in lower
    case.  A tier only ever upgrades to correct.
    """

    def judged(p: Column) -> Column:
        found, wanted = p["found"], p["wanted"]
        near = F.coalesce(F.abs(python_float(found) - python_float(wanted)) < 1e-5, F.lit(False)) | (F.lower(found) == F.lower(wanted))
        correct = (found != "") & near
        if symbolic:
            correct = correct | p["same"]
        return bound(correct, lambda c: F.struct(found.alias("candidate"), c.alias("is_correct"), message(found, wanted, c).alias("error_message")))

    def message(found: Column, wanted: Column, correct: Column) -> Column:
        differs = F.concat(F.lit("Answer mismatch. Candidate: "), found, F.lit(", Target: "), wanted)
        return F.when(found == "", F.lit("Could not extract mathematical answer from text.")).when(~correct, differs)

    found, wanted = math_answer(x), strip(F.coalesce(truth, F.lit("")))
    parts = [found.alias("found"), wanted.alias("wanted")]
    if symbolic:  # a Python function, so it stands outside of the lambda
        parts.append(F.when(found != "", same_expression(found, wanted)).otherwise(F.lit(False)).alias("same"))
    verdict = bound(F.struct(*parts), judged)
    return {k: verdict[k] for k in ("candidate", "is_correct", "error_message")}


def same_expression(a: Column, b: Column) -> Column:
    """Whether SymPy makes the difference of two expressions zero; false where they can't be read (:mod:`.expressions`) or it isn't installed.

    Nothing of the texts is evaluated as a program.
    """
    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        from .expressions import equal

        return pd.Series([equal(p, q) for p, q in zip(x, y)])

    return same(a, b)
