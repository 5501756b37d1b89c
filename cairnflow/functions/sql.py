"""The scalar functions as SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .answers import NUMBER, UNSAFE
from .text import SPACE, SPACES


def literal(x: str) -> str:
    """A raw SQL string: backslashes stay as they are."""
    return 'r"' + x + '"' if "'" in x else f"r'{x}'"


def without(x: str, *parts: str) -> str:
    """SQL of ``x`` with every one of the texts taken out."""
    for part in parts:
        x = f"replace({x}, {literal(part)}, '')"
    return x


STRIPPED = f"btrim(%s, '{SPACES}')"
FLOAT = r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|(?i:inf|infinity|nan))$"
FLAT = "regexp_replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), r'\t[ \t]*+|  [ \t]*+| \t[ \t]*+', ' ')"
PLAIN_MATH = STRIPPED % without("x", "$", r"\(", r"\)", r"\[", r"\]")

#: (arguments, type, body) by name: scalars, and predicates.
FUNCTIONS = {
    "cairn_strip": ("x STRING", "STRING", STRIPPED % "x"),
    "cairn_words": ("x STRING", "ARRAY<STRING>", f"filter(split(x, {literal(f'{SPACE}+')}), w -> w <> '')"),
    "cairn_clean_whitespace": ("x STRING", "STRING", f"array_join(filter(transform(split({FLAT}, chr(10)), l -> {STRIPPED % 'l'}), l -> l <> ''), chr(10))"),
    "cairn_normalize_math": ("x STRING", "STRING", STRIPPED % rf"replace(replace({PLAIN_MATH}, r'\percent', '%'), r'\%', '%')"),
    "cairn_last_number": ("x STRING", "STRING", f"try_element_at(regexp_extract_all(x, {literal(NUMBER)}, 0), -1)"),
    "cairn_float": ("x STRING", "DOUBLE", f"CASE WHEN {STRIPPED % 'x'} RLIKE {literal(FLOAT)} THEN try_cast(replace({STRIPPED % 'x'}, '_', '') AS DOUBLE) END"),
    "cairn_gsm8k_answer": ("x STRING", "STRING", STRIPPED % "element_at(split(x, '####'), -1)"),
    "cairn_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE) END"),
    "cairn_is_unsafe": ("x STRING", "BOOLEAN", "coalesce(" + " OR ".join(f"x RLIKE {literal(p)}" for p in UNSAFE) + ", false)"),
    "cairn_has_answer": ("x STRING", "BOOLEAN", "coalesce(x RLIKE r'(?is)<answer>.*?</answer>', false)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session, table functions included; gives their names."""
    from . import tables

    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return sorted([*FUNCTIONS, *tables.register(spark)])
