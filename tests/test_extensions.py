"""Aggregates, table functions, committed sinks, hub scans, token batches, pooled code and expressions."""

import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import expressions, tables
from cairnflow.operators import aggregates, code_sandbox, generate, tokens, trajectories
from cairnflow.sources import committed, hub

# -- aggregates ---------------------------------------------------------------------------


def grouped(spark):
    """A group with most rows, small ones, and a null one; nulls and repeats in every column."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, "", "é字", "one two", f"t{rng.randrange(300)}"]), rng.choice([None, "x", f"a{i % 40}"]), rng.choice([None, 0, 5, i])) for i in range(4000)]
    return spark.createDataFrame(rows, "g string, i long, text string, extracted_answer string, token_count long").repartition(7)


def rows_of(df, *columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect()), key=repr)


def test_plugins_equal_the_built_in(spark, monkeypatch):
    rows = grouped(spark)
    columns = ("g", "total_responses", "unique_texts", "unique_answers", "duplicates", "avg_chars", "min_chars", "max_chars", "avg_tokens", "min_tokens", "max_tokens")
    some = F.when(F.col("token_count") > 0, F.col("token_count"))
    want = rows.groupBy("g").agg(
        F.count("*").alias("total_responses"), F.count_distinct("text").alias("unique_texts"), F.count_distinct("extracted_answer").alias("unique_answers"), (F.count("*") - F.count_distinct("text")).alias("duplicates"),
        F.avg(F.length("text")).alias("avg_chars"), F.min(F.length("text")).alias("min_chars"), F.max(F.length("text")).alias("max_chars"),
        F.coalesce(F.avg(some), F.lit(0.0)).alias("avg_tokens"), F.coalesce(F.min(some), F.lit(0)).alias("min_tokens"), F.coalesce(F.max(some), F.lit(0)).alias("max_tokens"),
    )
    want = rows_of(want, *columns)
    assert rows_of(aggregates.lexical(rows, "g"), *columns) == want
    monkeypatch.setattr(aggregates, "MOST_STATES", 1)
    assert rows_of(aggregates.lexical(rows, "g"), *columns) == want
    assert aggregates.lexical(rows.limit(0), "g").count() == 0


def test_only_states_are_shuffled(spark):
    """A hot group leaves a task as one state, and a spread one as one state a share."""
    rows = grouped(spark)
    plan = aggregates.aggregated(rows, "g", "lengths")._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.rindex("MapInArrow")]
    assert last.count("Exchange") == 1  # behind the partial states
    held = [r for r in rows.select("g", "text", "token_count").mapInArrow(lambda b: aggregates.partial(b, ["g"], aggregates.Lengths(), aggregates.to_arrow_schema(schema)), schema).collect()] if (schema := aggregates.StructType.fromDDL("g string, " + aggregates.Lengths.state)) else []
    assert len(held) <= 7 * 4


class Median(aggregates.Aggregate):
    """A plug-in of a user's own: the middle of whole numbers, from counts of each."""

    inputs, state, result = ("i",), "counts map<long,long>", "middle long"

    def init(self):
        return {"counts": []}

    def update(self, state, rows):
        return self.merge(state, {"counts": [(v, 1) for v in rows.column("i").to_pylist()]})

    def merge(self, a, b):
        out = dict(a["counts"])
        for v, n in b["counts"]:
            out[v] = out.get(v, 0) + n
        return {"counts": list(out.items())}

    def finish(self, state):
        values = [v for v, n in sorted(state["counts"]) for _ in range(n)]
        return {"middle": values[len(values) // 2]}


def test_a_plugin_of_ones_own(spark):
    aggregates.register("median", Median())
    got = rows_of(aggregates.aggregated(grouped(spark).withColumn("h", F.col("i") % 2), ["g", "h"], "median"), "g", "h", "middle")
    kept = {}
    for r in grouped(spark).collect():
        kept.setdefault((r["g"], r["i"] % 2), []).append(r["i"])
    assert got == sorted(((*k, sorted(v)[len(v) // 2]) for k, v in kept.items()), key=repr)
    with pytest.raises(KeyError, match="no aggregate"):
        aggregates.aggregated(grouped(spark), "g", "none")


def test_semantic_similarity(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), rng.normal(size=5).tolist()) for _ in range(60)]
    rows += [(1, None), (1, [0.0] * 5), (1, [float("nan")] * 5), (2, [1.0, None, 0.0]), (2, [1.0, 2.0]), (2, [2.0, 4.0]), (2, []), (2, [1e300, 1e300]), (7, [1.0]), (8, None), (8, [1.0]), (None, [1.0]), (None, [-3.0])]
    want = {}
    for g in {g for g, _ in rows}:
        mine = [v for h, v in rows if h == g]

        def cosine(a, b):
            if not a or not b or len(a) != len(b) or any(x is None or not np.isfinite(x) for x in a + b) or not any(a) or not any(b):
                return 0.0
            a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
            return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

        pairs = [cosine(mine[i], mine[j]) for i in range(len(mine)) for j in range(i)]
        want[g] = (len(mine), sum(pairs) / len(pairs) if pairs else 0.0)
    df = spark.createDataFrame(rows, "label int, embedding array<double>")
    for got in (trajectories.semantic_similarity(df, "label"), aggregates.aggregated(df, "label", "mean_cosine")):
        found = {r["label"]: (r["n_vectors"], r["avg_cosine"]) for r in got.collect()}
        assert set(found) == set(want) and all(found[g] == (want[g][0], pytest.approx(want[g][1], abs=1e-9)) for g in want)
    texts = df.selectExpr("label", "embedding", "'a b' AS text", "'x' AS extracted_answer", "1 AS token_count").where("label is not null")
    got = trajectories.diversity(texts, "label", "label", vector="embedding").collect()
    assert all(r["avg_semantic"] == pytest.approx(want[r["label"]][1], abs=1e-9) for r in got)


# -- table functions ----------------------------------------------------------------------


class Shouting(generate.Provider):
    name, model = "shouting", "loud"

    def generate(self, system, user, sampling, sample_index):
        if user == "bad":
            raise generate.ProviderError("no")
        return {"text": f"{system}{user.upper()} {sampling.temperature} STOP more", "token_count": 2, "finish_reason": "stop"}


def test_generation_in_sql(spark):
    assert "cairn_generate" in tables.register(spark, shouting=Shouting())
    rows = spark.createDataFrame([(str(i), None if i == 3 else "bad" if i == 5 else f"u{i}", "s:" if i % 2 else None, 0.25 if i % 3 == 0 else None) for i in range(40)], "id string, user_prompt string, system_prompt string, temperature double")
    rows.createOrReplaceTempView("asked")
    got = spark.sql("SELECT * FROM cairn_generate(TABLE(asked), provider => 'shouting', n => 2, temperature => 0.5D, stop => array('STOP'))")
    want = generate.run(rows, Shouting(), generate.Sampling(n=2, temperature=0.5, stop_sequences=["STOP"]))
    columns = [c for c in want.columns if c != "latency_ms"]
    assert got.columns == want.columns
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert spark.sql("SELECT count(*) FROM cairn_generate(TABLE(SELECT * FROM asked WHERE id < 0))").first()[0] == 0
    for call, said in (("TABLE(asked), provider => 'none'", "no provider"), ("TABLE(asked), odd => 1", "no settings"), ("TABLE(SELECT id FROM asked)", "user_prompt"), ("'x'", "TABLE")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM cairn_generate({call})").collect()


# -- committed sinks and hub scans --------------------------------------------------------


def test_failed_jobs_leave_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).selectExpr("id", "named_struct('a', id, 'b', array('x', null)) AS nested").repartition(5)
    committed.append(rows, path)
    fails = F.udf(lambda i: i if i != 57 else 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        committed.append(rows.withColumn("id", fails("id")), path)
    assert committed.read(spark, path).count() == 100
    committed.append(rows.where("id < 10"), path, "again")
    committed.append(rows.where("id < 10"), path, "again")  # played again
    got = committed.read(spark, path)
    assert got.schema == rows.schema
    assert sorted(r["id"] for r in got.collect()) == sorted([*range(100), *range(10)])
    assert got.where("nested.a = id and nested.b[0] = 'x' and nested.b[1] is null").count() == 110
    assert committed.tidied(path, 0.0) >= 0 and committed.read(spark, path).count() == 110
    listed = {f for c in committed.manifests(path) for f in c["files"]}
    assert set(os.listdir(tmp_path / "t" / "data")) == listed
    committed.append(rows.where("id < 3"), "file://" + path)
    rows.where("id < 2").write.format("cairn_committed").mode("overwrite").save(path)
    assert committed.read(spark, path).count() == 2


def test_attempts_that_do_not_count_leave_no_row(spark, tmp_path):
    """A speculative twin and an attempt that died: only what is committed is read."""
    path = str(tmp_path / "t")
    frame = spark.range(10).withColumnRenamed("id", "x")
    batch = frame.toArrow().to_batches()
    writer = committed.Writer(path, frame.schema, False, "c")
    counted, twin = writer.write(iter(batch)), writer.write(iter(batch))

    def dying():
        yield batch[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    assert twin.rows == 10 and not committed.manifests(path)
    with pytest.raises(Exception, match="no commits"):
        committed.read(spark, path)
    writer.commit([counted, None])
    assert committed.read(spark, path).count() == 10
    assert committed.tidied(path, 0.0) == 1
    empty = committed.Writer(path, frame.schema, True, "d")
    empty.commit([empty.write(iter([]))])
    assert committed.read(spark, path).count() == 0


def test_hub_datasets_are_read_by_row_groups(spark, tmp_path):
    rows = [{"question": f"q{i}", "answer": None if i % 7 == 0 else str(i), "n": {"x": [i]}} for i in range(1000)]
    home = tmp_path / "data" / "main"
    spark.createDataFrame(rows, "question string, answer string, n struct<x array<int>>").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(home / "train"))
    spark.range(5).write.parquet(str(home / "test"))
    got = hub.scan_hub(spark, str(tmp_path / "data"), "main")
    assert got.rdd.getNumPartitions() == 4
    found = {r["ordinal"]: json.loads(r["j"]) for r in got.selectExpr("ordinal", "to_json(raw) AS j").collect()}
    assert [found[i] for i in range(1000)] == rows
    assert hub.scan_hub(spark, "file://" + str(tmp_path / "data"), "main", "test").count() == 5
    with pytest.raises(Exception, match="no Parquet files"):
        hub.scan_hub(spark, str(tmp_path / "data"), "main", "dev").count()


# -- tokens -------------------------------------------------------------------------------


class Letters:
    pad_token_id, all_special_ids = 0, [0, 1]

    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, ids):
        return "".join(map(chr, ids))


def test_token_batches(spark):
    rng = random.Random(6)
    texts = ["x" * rng.choice([0, 1, 5, 5, 5, 30, 31, 200, 900]) + str(i) for i in range(700)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(6)
    cut = tokens.encode(rows, Letters, max_length=256)
    assert all(r["token_ids"] == [ord(c) for c in (r["text"] or "")[:256]] for r in cut.collect())
    assert all(r["token_ids"] == [ord(c) for c in (r["text"] or "")[-3:]] for r in tokens.encode(rows, Letters, max_length=3, keep="end").collect())
    for side in ("left", "right"):
        got = tokens.batched(cut, Letters, 16, side).collect()
        assert sorted(r["i"] for r in got) == list(range(701))
        of = {}
        for r in got:
            n, width = len(r["token_ids"]), len(r["input_ids"])
            own = r["input_ids"][width - n :] if side == "left" else r["input_ids"][:n]
            assert own == r["token_ids"] and sum(r["attention_mask"]) == n and len(r["attention_mask"]) == width
            assert r["attention_mask"] == ([0] * (width - n) + [1] * n if side == "left" else [1] * n + [0] * (width - n))
            of.setdefault(r["batch"], []).append((n, width))
        assert all(len(v) <= 16 and {w for _, w in v} == {max(n for n, _ in v)} for v in of.values())
        padding = sum(w - n for v in of.values() for n, w in v) / sum(w for v in of.values() for _, w in v)
        assert padding < 0.1  # batches as they come are mostly padding here
    back = tokens.decode(tokens.batched(cut, Letters), Letters, "input_ids", "back", skip_special=True).collect()
    assert all(r["back"] == (r["text"] or "")[:256] for r in back)
    assert tokens.batched(cut.limit(0), Letters).count() == 0


# -- code and expressions -----------------------------------------------------------------


def test_hanging_code_runs_in_a_pool(spark):
    rows = spark.createDataFrame([(str(i), "```python\nimport time\nwhile True: time.sleep(1)\n```", None) for i in range(200)], "id string, text string, assertions array<string>").coalesce(1)
    start = time.time()
    got = code_sandbox.verify(rows, allow_execution=True, timeout=2.0).collect()
    assert len(got) == 200 and all("Timeout" in r["error_message"] for r in got)
    assert time.time() - start < 200 * 2 / code_sandbox.POOL + 30


def test_children_are_bounded(tmp_path):
    run = lambda code, timeout=10.0: code_sandbox.execute(code, [], timeout)
    assert run("x = 1") is None
    assert "MemoryError" in run("x = bytearray(3 << 30)")
    assert run("for i in range(10**7): print('x' * 100)") is not None
    assert "OSError" in run("held = [open('f%d' % i, 'w') for i in range(200)]")
    assert run(f"open({str(tmp_path / 'big')!r}, 'wb').write(bytes(5 << 20))") is not None
    assert (tmp_path / "big").stat().st_size <= code_sandbox.OUTPUT
    late = tmp_path / "late"
    later = f"import time; time.sleep(3); open({str(late)!r}, 'w')"
    started = f"import subprocess, sys\nsubprocess.Popen([sys.executable, '-c', {later!r}])"
    assert run(started) is None  # what it leaves behind ends with it
    time.sleep(4)
    assert not late.exists()


def test_expressions_are_read_and_never_run():
    assert expressions.tree("x + 2*y") == ("+", ("name", "x"), ("*", ("number", "2"), ("name", "y")))
    assert expressions.tree("-sqrt(x)/.5") == ("/", ("*", ("number", "-1"), ("call", "sqrt", ("name", "x"))), ("number", ".5"))
    assert expressions.tree("x**(1/2)") is not None and expressions.tree("2**-3") is not None
    refused = ["", "__import__('os').system('x')", "().__class__", "x.y", "x[0]", "lambda: 1", "[x for x in y]", "'a'", "f'{x}'", "open(x)", "exec(x)", "sqrt(x, y)", "sqrt(x=1)", "9**9**9", "9**99999", "x**y**z", "2**(3+4)", "1" * 41, "1e999", "0x10", "1_0", "1j", "x if y else z", "x == y", "x := 1", "(" * 100 + ")" * 100, "+".join("x" * 300), "x;y", "_x", "__x__", "x\ny", "-" * 60 + "x"]
    assert [t for t in refused if expressions.tree(t) is not None] == []
    assert expressions.equal("y + x", "y+x") and not expressions.equal("x", "9**9**9")


def test_symbolic_verdicts(spark):
    pytest.importorskip("sympy")
    assert expressions.equal("y + x", "x + y") and expressions.equal("0.5 * x", "1/2 * x") and not expressions.equal("y - x", "x + y")


# -- plans --------------------------------------------------------------------------------


def test_best_of_limits_groups_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 2 * 0 AS g", "id")
    best = trajectories.best_of(rows, "g", 3, F.desc("id"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert [r["id"] for r in best.orderBy("place").collect()] == [999, 998, 997]


def test_generation_takes_a_gpu_profile(spark):
    from cairnflow.operators.local_models import gpu_profile

    profile = gpu_profile(per_task=0.5, cores=4)
    assert profile.taskResources["gpu"].amount == 0.5 and profile.executorResources["gpu"].amount == 1
    rows = spark.createDataFrame([("1", "u")], "id string, user_prompt string")
    asked = []
    plain = type(rows).mapInPandas

    def mapped(self, *a, **k):
        asked.append(k.get("profile"))
        return plain(self, *a)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "mapInPandas", mapped)
        generate.run(rows, generate.MockProvider(), generate.Sampling(), profile=profile)
    assert asked == [profile]


def test_engines_are_made_once_a_worker(monkeypatch):
    import sys
    import types

    from cairnflow.operators import local_models

    made = []
    monkeypatch.setitem(sys.modules, "vllm", types.SimpleNamespace(LLM=lambda **k: made.append(k) or object()))
    monkeypatch.setattr(local_models, "_engines", {})
    for _ in range(3):  # three tasks
        p = local_models.VLLMProvider("m", dtype="auto")
        p.open()
        p.close()
    assert made == [{"model": "m", "dtype": "auto"}]
    local_models.VLLMProvider("other").open()
    assert len(made) == 2 and len(local_models._engines) == 1
