"""JSON lists in many splits against Python's own reader."""

import json
import random

import pytest

from cairnflow.sources import json_lists, readers


@pytest.fixture
def splits(spark):
    """Sets the bytes of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def put(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield put
    for n, v in before.items():
        spark.conf.set(n, v)


PARTS = ["a", "[", "]", "{", "}", ",", '"', "\\", "\\\\", '\\"', "é", "字", "😀", " ", "\n", "],[", '","', "x" * 40]


def odd_text(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))


def odd_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 5)
    if kind < 3:
        return odd_text(rng)
    if kind == 3:
        return rng.choice([None, True, False, 0, -1.5, 123456789])
    if kind == 4:
        return []
    if kind < 7:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {odd_text(rng) if rng.random() < 0.3 else f"k{i}": odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


def read(df):
    rows = df.selectExpr("ordinal", "to_json(raw) AS j").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows)))
    return [json.loads(r["j"]) for r in rows]


@pytest.mark.parametrize(("size", "indent", "ascii"), [(37, None, True), (64, 1, False), (200, None, False), (100_000, 2, True)])
def test_lists_in_many_splits(spark, tmp_path, splits, size, indent, ascii):
    rng = random.Random(size)
    want = [odd_value(rng) for _ in range(60)] + ["y" * 900, {"deep": [[[[["z" * 300]]]]]}, "", [[]]]
    rng.shuffle(want)
    (tmp_path / "a.json").write_text(rng.choice(["", " \n"]) + json.dumps(want, indent=indent, ensure_ascii=ascii) + "\n  ", encoding="utf-8")
    splits(size)
    assert json_lists.pieces(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() >= (15 if size < 1000 else 1)
    assert read(readers.scan_json(spark, str(tmp_path / "a.json"))) == want


def test_lists_of_a_folder(spark, tmp_path, splits):
    lists = {"a": list(range(500)), "b": [], "c": [{"x": "[,]"}] * 30, "d": [7], "e": [[], [1, [2]]]}
    for name, v in lists.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(v))
    splits(50)
    assert read(readers.scan_json(spark, str(tmp_path))) == [x for v in lists.values() for x in v]
    (tmp_path / "f.json").write_text('{"a": [1]}')
    with pytest.raises(ValueError, match="f.json isn't a JSON list"):
        readers.scan_json(spark, str(tmp_path))


@pytest.mark.parametrize("text", ["", "  ", "5", '"[]"', '{"a": [1, 2]}', "[1, 2", "1, 2]", '["a, b]', "[1}", "[[1]"])
def test_no_lists(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="isn't a JSON list"):
        readers.scan_json(spark, str(tmp_path / "a.json"))


@pytest.mark.parametrize("text", ["[1,,2]", "[1, 2,]", "[1], [2]", "[1] [2]", "[nope]", "[,]", "[1 2]", '[{"a": 1} x]', '[{"a": 1}\n{"a": 2}]'])
def test_broken_lists_raise_when_read(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        read(readers.scan_json(spark, str(tmp_path / "a.json")))


def test_prompts_of_a_large_list(spark, tmp_path, splits):
    want = [{"problem": f"p{k}, [{k}", "id": "" if k % 3 else f"i{k}"} for k in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(want))
    splits(100)
    got = readers.scan_prompts(spark, str(tmp_path / "a.json")).collect()
    assert sorted((r["id"], r["user_prompt"]) for r in got) == sorted((w["id"] or f"prompt-{k}", w["problem"]) for k, w in enumerate(want))
    (tmp_path / "b.jsonl").write_text("".join(f"{json.dumps(w)}\n\n" for w in want))
    got = readers.scan_prompts(spark, str(tmp_path / "b.jsonl")).collect()
    assert sorted((r["id"], r["user_prompt"]) for r in got) == sorted((w["id"] or f"prompt-{2 * k}", w["problem"]) for k, w in enumerate(want))
    # it begins as a list, but its elements aren't JSON: its lines are read instead
    (tmp_path / "c.jsonl").write_text('[\n{"problem": "one"}\n{"problem": "two"}\n]\n')
    assert sorted((r["id"], r["user_prompt"]) for r in readers.scan_prompts(spark, str(tmp_path / "c.jsonl")).collect()) == [("prompt-1", "one"), ("prompt-2", "two")]
    (tmp_path / "d.jsonl").write_text(" \n")
    assert readers.scan_prompts(spark, str(tmp_path / "d.jsonl")).count() == 0


def test_lines_are_numbered_in_two_passes(spark, tmp_path):
    """One shuffle, of the splits' counts; the lines themselves aren't moved."""
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{bad\n\n{"a": 2}\n')
    df = readers.scan_jsonl(spark, str(tmp_path / "a.jsonl"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1
    assert [r[0] for r in df.orderBy("ordinal").select("ordinal").collect()] == [0, 1]


def test_lines_hold_one_value_and_nothing_more(spark, tmp_path):
    lines = ['{"a": 1}', '{"a": 1} x', '{"a": 1}{"b": 2}', '{"a": 1}]', '{"a": 1},2] y', "1, 2", "5", "null", '"x"', "NaN", "{'a': 1}", '{"a": 1', ' {"a": [1, 2]} ']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = readers.scan_jsonl(spark, str(tmp_path / "a.jsonl")).selectExpr("ordinal", "to_json(raw) AS j").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["j"]) for r in got] == list(enumerate(['{"a":1}', "5", "null", '"x"', '{"a":[1,2]}']))
    assert [r[0] for r in readers.rejects(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()] == [1, 2, 3, 4, 5, 9, 10, 11]
