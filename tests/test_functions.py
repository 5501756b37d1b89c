"""Column functions against Python's own behaviour and hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import answers as A
from cairnflow.functions import text as T


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    out = rows.select("i", make(F.col("text")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def soup(n, seed=1):
    rng = random.Random(seed)
    parts = ["<think>", "</think>", "<Think>", "<answer>", "</answer>", "<ANSWER>", "\\boxed{", "{", "}", "a", "12", "3.5", "-1/2", "\n", " ", " ", "\r\n", "x y", "$", "\\(", "\\)", "\\%", "```python", "```"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_strip_and_words_match_python(spark):
    rng = random.Random(0)
    values = ["".join(rng.choice([*SPACES, "a", "b", "é"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    assert column(spark, values, T.strip) == [v.strip() for v in values]
    assert column(spark, values, T.words) == [v.split() for v in values]


def test_clean_whitespace(spark):
    values = ["  hello   world \n\n new   line   ", "a\r\nb\rc", "", "\t"]
    want = ["\n".join(x for x in (line.strip() for line in re.sub("[ \t]+", " ", v.replace("\r\n", "\n").replace("\r", "\n")).split("\n")) if x) for v in values]
    assert column(spark, values, T.clean_whitespace) == want
    assert want[0] == "hello world\nnew line"


def test_normalize_math(spark):
    values = ["$x^2 + y = 3$", "\\( \\frac{a}{b} \\)", "50\\percent", "5\\%"]
    assert column(spark, values, T.normalize_math) == ["x^2 + y = 3", "\\frac{a}{b}", "50%", "5%"]


def test_python_float(spark):
    values = ["1d", "1_000", " 12 ", "inf", "nan", "1e5", "1f", ".5", "5.", "1__0", "", "abc", "0x1"]

    def want(v):
        try:
            return float(v)
        except ValueError:
            return None

    for got, w in zip(column(spark, values, T.python_float), map(want, values)):
        assert got == w or (got != got and w != w)


def balanced(text):
    at = text.find("\\boxed{")
    if at < 0:
        return None
    depth, i = 1, at + 7
    while i < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        i += 1
    return None if depth else text[at + 7 : i - 1].strip()


def tail(text):
    found = re.findall(A.NUMBER, text)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return found[-1] if found else lines[-1] if lines else ""


def parsed(text):
    think = re.search("(?is)<think>(.*?)</think>", text)
    tag = re.search("(?is)<answer>(.*?)</answer>", text)
    answer = tag[1].strip() if tag else balanced(text) or ""
    if not answer and think:
        answer = tail(text[think.end() :].strip())
    return (think[1].strip() if think else ""), answer or tail(text)


def test_parse_response_matches_specification(spark):
    values = soup(1500)
    got = column(spark, values, lambda x: F.struct(*(A.parse_response(x)[k].alias(k) for k in ("thinking", "answer"))))
    assert [(g["thinking"], g["answer"]) for g in got] == [parsed(v) for v in values]


def test_math_answer_matches_specification(spark):
    def want(text):
        tag = re.search("(?s)<answer>(.*?)</answer>", text)
        if tag:
            return tag[1].strip()
        box = balanced(text)
        if box is not None:
            return box
        found = re.findall(A.NUMBER, text)
        return found[-1] if found else text.strip()

    values = soup(1500, 2)
    assert column(spark, values, A.math_answer) == [want(v) for v in values]


@pytest.mark.parametrize(
    ("text", "thinking", "answer"),
    [
        ("<think>We need to sum 2 + 2.</think>\nSome intermediate text.\n<answer>4</answer>", "We need to sum 2 + 2.", "4"),
        ("<think>Let x be the result.</think>\nTherefore, the answer is \\boxed{42}.", "Let x be the result.", "42"),
        ("The value is \\boxed{\\frac{1}{2}}.", "", "\\frac{1}{2}"),
        ("<think>Thinking trace here.</think>\nSo the final total is 9.5.", "Thinking trace here.", "9.5"),
        ("Calculating value...\nDone. The result is positive.", "", "Done. The result is positive."),
        ("", "", ""),
    ],
)
def test_parse_cases(spark, text, thinking, answer):
    got = column(spark, [text], lambda x: F.struct(*(c.alias(k) for k, c in A.parse_response(x).items())))[0]
    assert (got["thinking"], got["answer"]) == (thinking, answer)


def test_code_and_unsafe(spark):
    values = ["```python\nimport os\n```", "x ```py\na=1\n``` y", "<answer>eval(1)</answer>", " pass "]
    assert column(spark, values, A.code) == ["import os", "py\na=1", "eval(1)", "pass"]
    assert column(spark, values, lambda x: A.unsafe_pattern(A.code(x))) == [r"import\s+os", None, r"eval\(", None]


def test_math_verdict(spark):
    rows = spark.createDataFrame([("<answer>3.141590</answer>", "3.14159"), ("Yes", "yes"), ("5", "6"), ("<answer></answer>", "1"), (None, "1")], "text string, truth string")
    v = A.math_verdict(F.col("text"), F.col("truth"))
    got = rows.select(v["is_correct"].alias("c"), v["error_message"].alias("m")).collect()
    assert [r["c"] for r in got] == [True, True, False, False, False]
    assert got[2]["m"] == "Answer mismatch. Candidate: 5, Target: 6"


def test_stop_truncate(spark):
    assert column(spark, ["a b </answer> c total", "total", "  none  "], lambda x: T.stop_truncate(x, ["</answer>", "total"])) == ["a b", "", "  none  "]


def test_clean_whitespace_matches_lines(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice([*SPACES, "\n", "\n", " ", "a", "b"]) for _ in range(rng.randrange(20))) for _ in range(600)] + [" " * 20000 + "x" + " " * 20000]

    def want(v):
        flat = re.sub("[ \t]+", " ", v.replace("\r\n", "\n").replace("\r", "\n"))
        return "\n".join(x for x in (line.strip() for line in flat.split("\n")) if x)

    assert column(spark, values, T.clean_whitespace) == [want(v) for v in values]


def test_fixed_is_pythons(spark):
    """Ties go to the even digit, and what is a tie in decimals alone is none."""
    shares = [a / b for b in range(1, 65) for a in range(b + 1)] + [0.0625, 0.1875, 0.145, 0.0115]
    df = spark.createDataFrame([(x,) for x in shares], "x double")
    got = df.select("x", T.fixed(F.col("x") * 100, 1).alias("p"), T.fixed(F.col("x"), 3).alias("f")).collect()
    assert all(f"{r['p']}%" == f"{r['x']:.1%}" and r["f"] == f"{r['x']:.3f}" for r in got)
