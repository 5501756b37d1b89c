"""Verifiers by task type: factories of a verdict's columns, and parsing with the verdict beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from . import code_sandbox

#: (text, truth, assertions) -> (is_correct, error message).
Verifier = Callable[[Column, Column, Column], tuple[Column, Column]]
_verifiers: dict[str, Verifier] = {}


def register(task_type: str, verifier: Verifier) -> None:
    """Register a verifier; a second one of a type takes its place."""
    _verifiers[task_type] = verifier


def verifier(task_type: str) -> Verifier:
    if task_type not in _verifiers:
        raise KeyError(f"no verifier for {task_type!r}; there are {sorted(_verifiers)}")
    return _verifiers[task_type]


def math(text: Column, truth: Column, assertions: Column) -> tuple[Column, Column]:
    v = answers.math_verdict(text, truth)
    return v["is_correct"], v["error_message"]


def symbolic_math(text: Column, truth: Column, assertions: Column) -> tuple[Column, Column]:
    v = answers.math_verdict(text, truth, symbolic=True)
    return v["is_correct"], v["error_message"]


def static_code(text: Column, truth: Column, assertions: Column) -> tuple[Column, Column]:
    return code_sandbox.verdict(text, assertions)


def executed_code(text: Column, truth: Column, assertions: Column) -> tuple[Column, Column]:
    return code_sandbox.verdict(text, assertions, allow_execution=True)


register("math", math)
register("symbolic_math", symbolic_math)
register("code", static_code)
register("executed_code", executed_code)  # opt in: it runs what models wrote


def verdict(text: Column, truth: Column, assertions: Column, task_type: Column, among: list[str]) -> tuple[Column, Column]:
    """The verdict by each row's task type; a type that isn't ``among`` the given ones is false with a message."""
    right, error = F.lit(False), F.concat(F.lit("Verifier exception: no verifier for "), F.coalesce(task_type, F.lit("null")))
    for name in among:
        r, e = verifier(name)(text, truth, assertions)
        right, error = F.when(task_type == name, r).otherwise(right), F.when(task_type == name, e).otherwise(error)
    return right, error


def verify(rows: DataFrame, task_type: str | Column = "math", among: tuple[str, ...] = ("math", "code"), text: str = "text", truth: str = "ground_truth_answer", assertions: str = "assertions") -> DataFrame:
    """With thinking_trace, extracted_answer, reasoning_length_chars, is_correct and verify_error.

    The fields come from the parser and the verdict from the verifier's own extractor, so they
    can disagree.  ``task_type`` is one type, whose verifier must be there, or a column with a
    type for each row.  Columns of truths and assertions may be missing.
    """
    wanted = F.col(truth) if truth in rows.columns else F.lit("")
    tests = F.col(assertions) if assertions in rows.columns else F.array().cast("array<string>")
    if isinstance(task_type, str):
        right, error = verifier(task_type)(F.col(text), wanted, tests)
    else:
        right, error = verdict(F.col(text), wanted, tests, task_type, list(among))
    parsed = answers.parse_response(F.col(text))
    return rows.withColumns({"thinking_trace": parsed["thinking"], "extracted_answer": parsed["answer"], "reasoning_length_chars": parsed["reasoning_length_chars"], "is_correct": right, "verify_error": error})
