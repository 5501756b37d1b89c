"""Operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from cairnflow.operators import code_sandbox, generate, prompts, records, trajectories
from cairnflow.plans import grids
from cairnflow.sources import config, readers
from cairnflow.streaming import events, ingest


def test_gsm8k_load(spark, tmp_path):
    rows = [{"question": "What is 2+2?", "answer": "a #### 4", "id": "q1"}, {"question": "3+3", "answer": "#### 6", "id": "q2"}, {"question": "again", "answer": "#### 6", "id": "q2"}, {"question": "", "answer": "#### 1", "id": "q3"}, {"question": None, "answer": "1"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(rows[0]), "", "{bad", *map(json.dumps, rows[1:])]))
    for scan in (readers.scan_json(spark, str(tmp_path / "a.json")), readers.scan_jsonl(spark, str(tmp_path / "a.jsonl"))):
        kept, report = records.load(scan, "gsm8k")
        assert [(r["id"], r["ground_truth_answer"]) for r in kept.orderBy("id").collect()] == [("q1", "4"), ("q2", "6")]
        assert report.first().asDict() == {"n_raw": 5, "n_loaded": 2, "n_malformed": 2, "n_duplicates": 1}
    assert [r[0] for r in readers.rejects(spark, str(tmp_path / "a.jsonl")).collect()] == [2]


def test_scans_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.scan_json(spark, str(tmp_path / "none.json"))
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="isn't a JSON list"):
        readers.scan_json(spark, str(tmp_path / "o.json"))
    with pytest.raises(KeyError):
        records.mapper("none")


def test_scan_prompts(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"problem": "", "query": "q", "id": 0}\n\n{"user_prompt": "u", "task_id": 7}\n')
    got = readers.scan_prompts(spark, str(tmp_path / "p.jsonl"), "s").orderBy("user_prompt").collect()
    assert [(r["id"], r["user_prompt"], r["system_prompt"]) for r in got] == [("prompt-0", "q", "s"), ("7", "u", "s")]


def test_ingest(spark):
    e = spark.createDataFrame([("e1", "  hello   world  ", " $42$ ", 0), ("e2", "p", "1", 1), ("e1", "x", "y", 2), (" ", "p", "1", 3), ("e3", "p", None, 4)], "id string, prompt string, ground_truth_answer string, ordinal long")
    got = records.ingest(e).orderBy("id").collect()
    assert [(r["id"], r["prompt"], r["ground_truth_answer"]) for r in got] == [("e1", "hello world", "42"), ("e2", "p", "1")]
    assert records.ingest(e.limit(0)).count() == 0


def test_mbpp(spark):
    raw = '{"task_id": 3, "text": "t", "code": "c", "test_list": ["assert 1", {"assertion": "b"}, 5]}'
    r = records.mbpp(spark.sql(f"SELECT 0L AS ordinal, parse_json('{raw}') AS raw")).first()
    assert r["id"] == "3"
    assert r["test_cases"] == [{"assertion": "assert 1"}, {"assertion": "b"}]


def test_grid_and_compose(spark):
    p = spark.createDataFrame([("q1", "Calculate 5 + 5."), ("q2", "two")], "id string, user_prompt string")
    recipe = grids.Recipe(personas=["analytical", "teacher"], query_rewrites=["standard", "elegant"], temperatures=[0.5, 1.0], samples_per_configuration=2)
    jobs = grids.jobs(p, recipe)
    assert jobs.count() == 32
    first = jobs.orderBy("prompt_id", "combo").first()
    assert first["job_id"] == "q1_analytical_default_standard_standard_t0.5_p1.0_sNone_idx0"
    dims = [prompts.dimension(spark, prompts.assets("personas"), "persona"), spark.createDataFrame([], "strategy string, strategy_text string"), prompts.dimension(spark, prompts.assets("styles"), "style")]
    c = prompts.compose(jobs.where("rewrite = 'elegant' and persona = 'analytical'"), *dims).first()
    assert "shortcut" in c["user_prompt"]
    assert "rigor" in c["system_prompt"]
    bare = prompts.compose(jobs.withColumn("persona", F.lit("nobody")).withColumn("style", F.lit("none")), *dims).first()
    assert bare["system_prompt"] == prompts.DEFAULT_SYSTEM
    assert len(prompts.assets("personas")) == 8
    assert len(prompts.assets("styles")) == 5
    assert grids.sampling_groups(jobs).count() == 2
    assert grids.experiment(p, {}, {"s": "x"}, [1.0], [1]).count() == 0


def test_diversity(spark):
    rows = [("p1", 0, "hello world", "42", 2), ("p1", 1, "hello world", "42", 2), ("p1", 2, "different text", "100", 3), ("p1", 3, "hello distinct world", "42", 3), ("p2", 0, "", "x", 0)]
    d = trajectories.diversity(spark.createDataFrame(rows, "p string, i int, text string, extracted_answer string, token_count int"), "p", "i").orderBy("p").collect()
    assert (d[0]["unique_texts"], d[0]["unique_answers"], d[0]["duplicates"], d[0]["min_tokens"], d[0]["max_tokens"]) == (3, 2, 1, 2, 3)
    assert d[0]["avg_jaccard"] == pytest.approx(7 / 18)
    assert d[0]["diversity_score"] == pytest.approx(11 / 36)
    assert (d[1]["avg_jaccard"], d[1]["avg_tokens"], d[1]["max_tokens"]) == (0.0, 0.0, 0)


@pytest.mark.parametrize("share", [3, 512])
def test_jaccard_of_split_groups(spark, monkeypatch, share):
    monkeypatch.setattr(trajectories, "SHARE", share)
    texts = [f"w{k % 5} w{k % 7} w{k % 3} x" for k in range(40)] + ["", "", "w1 x"]
    sets = [set(t.split()) for t in texts]
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    want = sum(len(a & b) / len(a | b) if a and b else 0.0 for a, b in pairs) / len(pairs)
    got = trajectories.pairwise_jaccard(spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)] + [("h", 0, "a")], "g string, k int, text string"), "g", "k").orderBy("g").collect()
    assert got[0]["avg_jaccard"] == pytest.approx(want) and got[1]["avg_jaccard"] == 0.0


def test_leaderboard(spark):
    rows = [("teacher", True, 10, 0), ("analytical", None, 11, 1), ("teacher", False, 10, 2), (None, True, 5, 3)]
    board = trajectories.leaderboard(spark.createDataFrame(rows, "persona string, is_correct boolean, token_count int, ordinal int")).orderBy("place").collect()
    assert [(r["persona"], r["correctness"], r["avg_tokens"]) for r in board] == [("teacher", "50.0%", 10), ("analytical", "0.0%", 11), ("unknown", "100.0%", 5)]


def test_resume_and_sink(spark, tmp_path):
    s = spark.sql("SELECT named_struct('id', 'p1') AS prompt, 1 AS x UNION ALL SELECT named_struct('id', 'p2'), 2")
    readers.append_spectra(s, str(tmp_path / "out"))
    (tmp_path / "out" / "broken.json").write_text("{bad\n")
    done = readers.completed_ids(spark, str(tmp_path / "out"))
    assert sorted(r[0] for r in done.collect()) == ["p1", "p2"]
    p = spark.createDataFrame([("p1",), ("p3",), ("p3",)], "id string")
    assert [r[0] for r in trajectories.pending(p, done).collect()] == ["p3", "p3"]
    assert readers.completed_ids(spark, str(tmp_path / "nowhere")).count() == 0


class Flaky(generate.Provider):
    name = "flaky"

    def generate(self, system, user, sampling, sample_index):
        if user == "bad":
            raise generate.ProviderError("no")
        return {"text": user, "token_count": 1, "finish_reason": "stop"}


def test_generate_keeps_siblings(spark, tmp_path):
    p = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", None)], "id string, user_prompt string")
    out = generate.write_once(generate.run(p, generate.MockProvider(), generate.Sampling(n=3, seed=1)), str(tmp_path / "g"))
    assert out.count() == 9
    got = {r["prompt_id"]: r["error"] for r in generate.run(p, Flaky(), generate.Sampling()).collect()}
    assert got == {"1": None, "2": "ProviderError: no", "3": None}
    assert {r["error_class"] for r in generate.run(p, Flaky(), generate.Sampling()).collect()} == {None, "ProviderError"}


class Batched(generate.Provider):
    """Takes batches alone, and answers with the batch's size."""

    name, model = "batched", "m1"

    def generate_batch(self, tasks, sampling, concurrency):
        return [({"text": f"{len(tasks)} END {sampling.temperature}", "token_count": 1, "finish_reason": "stop"}, 0.5)] * len(tasks)


def test_generate_by_the_jobs_own_sampling(spark):
    """Two temperatures by three seeds give six texts; batches hold one sampling; texts are cut at stops."""
    p = spark.createDataFrame([(f"{t}-{s}", "same", t, s) for t in (0.5, 1.0) for s in (1, 2, None)], "id string, user_prompt string, temperature double, seed long")
    rows = generate.run(p, generate.MockProvider(), generate.Sampling(temperature=3.0, top_p=0.9, seed=77)).collect()
    assert len({r["text"] for r in rows}) == 6
    assert {r["prompt_id"]: (r["temperature"], r["seed"], r["top_p"]) for r in rows} == {f"{t}-{s}": (t, s, 0.9) for t in (0.5, 1.0) for s in (1, 2, None)}
    assert len({r["response_id"] for r in rows}) == 6
    again = generate.run(p, generate.MockProvider(), generate.Sampling(temperature=3.0, top_p=0.9, seed=77)).collect()
    assert {r["response_id"] for r in rows} == {r["response_id"] for r in again}
    many = spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit("u").alias("user_prompt"), F.when(F.col("id") < 10, 0.1).otherwise(0.2).alias("temperature")).coalesce(1)
    got = generate.run(many, Batched(), generate.Sampling(n=2, stop_sequences=["END"]), batch_size=16).collect()
    assert {r["text"] for r in got if r["temperature"] == 0.1} == {"20"}
    assert {r["text"] for r in got if r["temperature"] == 0.2} == {"32", "28"}
    assert {(r["provider"], r["model"], r["latency_ms"]) for r in got} == {("batched", "m1", 500.0)}


def test_retry():
    slept, tries = [], []

    def call():
        tries.append(1)
        raise generate.RateLimitError("x", 5.0 if len(tries) == 1 else 0.0)

    with pytest.raises(generate.RateLimitError):
        generate.retry(call, retries=3, jitter=False, sleep=slept.append)
    assert (len(tries), slept) == (4, [5.0, 1.0, 2.0])
    assert isinstance(generate.error_of_status(403, ""), generate.AuthError)
    assert not isinstance(generate.error_of_status(503, ""), generate.RetryableError)
    with pytest.raises(generate.ProviderError):
        generate.read_response({"choices": []})


def test_sandbox(spark):
    fence = lambda c: f"```python\n{c}\n```"
    rows = [("1", fence("def f(): return 1"), ["assert f() == 1"]), ("2", fence("def f(): return 2"), ["assert f() == 1"]), ("3", fence("import os"), None), ("4", fence("while True: pass"), None)]
    df = spark.createDataFrame(rows, "id string, text string, assertions array<string>")
    assert [r["is_correct"] for r in code_sandbox.verify(df).orderBy("id").collect()] == [None, None, False, None]
    got = code_sandbox.verify(df, allow_execution=True, timeout=1.0).orderBy("id").collect()
    assert [r["is_correct"] for r in got] == [True, False, False, False]
    assert "AssertionError" in got[1]["error_message"]
    assert "Timeout" in got[3]["error_message"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("CAIRN_A", "x")
    assert config.resolved({"a": ["${CAIRN_A}-${CAIRN_NONE}", 1]}) == {"a": ["x-", 1]}
    (tmp_path / "r.json").write_text(json.dumps({"name": "m", "version": "v2", "personas": ["a"], "other": 1, "sampling": {"temperatures": [0.5]}}))
    (tmp_path / "bad.json").write_text("[1]")
    found = config.find_recipe(tmp_path, "m@v2")
    assert (found.personas, found.temperatures) == (["a"], [0.5])
    with pytest.raises(KeyError):
        config.find_recipe(tmp_path, "none")
    assert config.find_recipe(prompts.ASSETS / "recipes", "mixed").temperatures == [0.4, 0.7, 1.0]
    assert set(config.experiment(prompts.ASSETS / "experiments" / "personas.json").recipes) == {"mixed", "one_persona"}
    assert config.engine(prompts.ASSETS / "engines" / "vllm.json").scheduler.batch_size == 64
    assert config.sampling(prompts.ASSETS / "sampling" / "diverse.json").n == 32
    assert isinstance(config.provider(config.ProviderConfig(), "api"), generate.HTTPProvider)
    with pytest.raises(ValueError, match="no provider"):
        config.provider(config.ProviderConfig(type="x"))
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError, match="empty"):
        config.read(tmp_path / "e.json")


def test_ordinals_of_wide_rows(spark):
    """Wide rows sorted by a column far from their order, with adaptive execution on."""
    rows = spark.range(60_000).select(F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("k"), F.repeat(F.lit("x"), 512).alias("wide")).repartition(50)
    got = records.with_ordinal(rows, "k").agg(F.count("ordinal"), F.count_if(F.col("k") == F.col("ordinal"))).first()
    assert tuple(got) == (60_000, 60_000)


def test_lines_count_through_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a", 3), ("b", 500), ("c", 40)):  # the reader takes the largest file first
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(json.dumps({"f": name, "k": k, "pad": "x" * 200}) + "\n" for k in range(n)) + "\n{bad\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [(r["f"], r["k"]) for r in readers.scan_jsonl(spark, str(tmp_path / "in")).orderBy("ordinal").selectExpr("variant_get(raw, '$.f', 'string') AS f", "variant_get(raw, '$.k', 'int') AS k").collect()]
        assert [r[0] for r in readers.rejects(spark, str(tmp_path / "in")).orderBy("line").collect()] == [4, 506, 548]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(name, k) for name, n in (("a", 3), ("b", 500), ("c", 40)) for k in range(n)]


def test_falsy_ids_and_metadata(spark, tmp_path):
    rows = [{"question": "q", "answer": "steps #### 4 ", "id": i} for i in (0, False, 0.0, "0", "", 7, None)] + [{"question": "q", "answer": "5"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    kept, report = records.load(readers.scan_jsonl(spark, str(tmp_path / "a.jsonl")), "gsm8k")
    assert sorted(r["id"] for r in kept.collect()) == ["0", "7", "gsm8k-7"]
    assert report.first()["n_malformed"] == 5
    got = {r["id"]: r["metadata"] for r in kept.collect()}
    assert got["7"] == {"full_answer_steps": "steps #### 4", "index": "5", "dataset": "gsm8k"}


def test_checkpoint_and_best_effort_sink(spark, tmp_path):
    one, two = (readers.Checkpoint(spark, str(tmp_path / "cp"), name) for name in ("one", "two"))
    assert one.completed().count() == 0
    one.mark(spark.range(3))
    one.mark(spark.range(2, 5))
    two.mark(spark.range(9, 10))
    assert sorted(r[0] for r in one.completed().collect()) == ["0", "1", "2", "3", "4"]
    assert [r[0] for r in two.completed().collect()] == ["9"]
    (tmp_path / "file").write_text("x")
    assert readers.append_spectra(spark.range(1), str(tmp_path / "file" / "sub"), best_effort=True) is False
    with pytest.raises(Exception):  # noqa: B017
        readers.append_spectra(spark.range(1), str(tmp_path / "file" / "sub"))


def test_verifiers(spark):
    from cairnflow.operators import verifiers

    fence = "```python\ndef f(): return 1\n```"
    rows = spark.createDataFrame([("math", "<answer>0.5</answer>", "1/2", None), ("code", fence, "", ["assert f() == 1"]), ("code", "```python\nimport os\n```", "", None), ("odd", "x", "x", None), (None, "x", "x", None)], "kind string, text string, ground_truth_answer string, assertions array<string>")
    got = verifiers.verify(rows, F.col("kind")).collect()
    assert [(r["is_correct"], (r["verify_error"] or "")[:8]) for r in got] == [(False, "Answer m"), (None, ""), (False, "Security"), (False, "Verifier"), (False, "Verifier")]
    assert [r["is_correct"] for r in verifiers.verify(rows.where("kind = 'code'"), "executed_code").collect()] == [True, False]
    with pytest.raises(KeyError, match="no verifier"):
        verifiers.verify(rows, "none")
    verifiers.register("length", lambda text, truth, tests: (F.length(text) == truth.cast("int"), F.lit(None).cast("string")))
    assert verifiers.verify(spark.createDataFrame([("abc", "3")], "text string, ground_truth_answer string"), "length").first()["is_correct"]
    # without the library the symbolic tier changes nothing
    assert [r["is_correct"] for r in verifiers.verify(rows.where("kind = 'math'"), "symbolic_math").collect()] in ([False], [True])


def test_sandbox_errors_are_rows(spark):
    assert code_sandbox.execute("import sys; sys.stderr.buffer.write(bytes([255])); sys.exit(1)", [], 5.0).startswith("Execution error:")
    assert code_sandbox.execute("x = '\0'", [], 5.0).startswith("Execution error:")


EXPERIMENT = """{"experiment": {"name": "ablation", "provider_config_path": "engine.json", "dataset_path": "data.jsonl", "output_dir": "out", "verifier_type": "math", "unknown": 1,
  "recipes": {"mixed": {"personas": ["analytical", "teacher"], "styles": ["standard"], "temperatures": [0.5, 0.8, 1.0], "seeds": [42], "samples_per_configuration": 2}, "none": {"personas": []}}}}"""


def test_experiment(spark, tmp_path):
    from cairnflow.plans import runner

    (tmp_path / "e.json").write_text(EXPERIMENT)
    (tmp_path / "engine.json").write_text('{"provider": {"type": "mock", "timeout": 5}, "sampling": {"top_p": 0.9, "max_tokens": 7, "odd": 1}, "scheduler": null}')
    (tmp_path / "data.jsonl").write_text('{"id": "a", "problem": "one", "answer": "1"}\n{"id": "b", "problem": "two", "answer": "2"}\n')
    e = config.experiment(tmp_path / "e.json")
    assert (e.dataset_path, e.output_dir) == (str((tmp_path / "data.jsonl").resolve()), str((tmp_path / "out").resolve()))
    settings = config.engine(e.provider_config_path)
    assert (settings.sampling.top_p, settings.sampling.max_tokens, settings.scheduler.batch_size, settings.provider.max_retries) == (0.9, 7, 16, 3)
    source = readers.scan_prompts(spark, e.dataset_path)
    truths = source.select(F.col("id").alias("prompt_id"), F.lit("1").alias("ground_truth_answer"))
    for _ in range(2):  # the second finds everything done
        out = runner.run_experiment(source, truths, e, "mixed", config.provider(settings.provider), settings.sampling)
    assert out["responses"].count() == 2 * 2 * 3 * 2
    s = out["spectra"].orderBy("prompt_id").first()
    assert (s["prompt"]["id"], s["n_responses"], s["metadata"]["total_candidates"], s["provider_info"]["provider"]) == ("a", 12, 12, "mock")
    assert s["metadata"]["correct_candidates"] + s["metadata"]["incorrect_candidates"] == 12
    assert len(s["responses"]) == 12 and {r["temperature"] for r in s["responses"]} == {0.5, 0.8, 1.0}
    assert s["diversity_statistics"]["total_responses"] == 12 and s["timing"]["total_tokens"] > 0 and s["sampling"]["top_p"] == 0.9
    summary = spark.read.json(f"{e.output_dir}/ablation/mixed/summary").first()
    assert (summary["recipe"], summary["experiment"], summary["num_completed_prompts"], summary["total_generated_trajectories"]) == ("mixed", "ablation", 2, 24)
    assert [r["persona"] for r in summary["persona_leaderboard"]] == ["analytical", "teacher"]
    assert sorted(r[0] for r in readers.completed_ids(spark, f"{e.output_dir}/ablation/mixed/spectra").collect()) == ["a", "b"]
    assert runner.run_experiment(source, truths, e, "none", config.provider(settings.provider), settings.sampling)["responses"].count() == 0
    with pytest.raises(KeyError, match="no recipe"):
        runner.run_experiment(source, truths, e, "other", generate.MockProvider(), settings.sampling)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from cairnflow import __main__ as cli

    monkeypatch.setattr(cli, "setup_logging", lambda *a: None)
    (tmp_path / "e.json").write_text(EXPERIMENT)
    (tmp_path / "engine.json").write_text('{"provider": {"type": "mock"}, "sampling": {"n": 2}, "prompts": {"system_prompt": "S."}}')
    (tmp_path / "data.jsonl").write_text('{"id": "a", "problem": "one", "answer": "1"}\n{"id": "b", "problem": "two"}\n')
    (tmp_path / "r.json").write_text('{"name": "r", "personas": ["teacher"], "sampling": {"temperatures": [0.1, 0.2]}}')
    run = lambda *a: cli.main([str(x) for x in a])
    run("--config", tmp_path / "engine.json", "--dataset", tmp_path / "data.jsonl", "--out", tmp_path / "plain")
    assert spark.read.parquet(str(tmp_path / "plain" / "responses")).count() == 4
    run("--config", tmp_path / "engine.json", "--dataset", tmp_path / "data.jsonl", "--out", tmp_path / "plain")
    assert spark.read.parquet(str(tmp_path / "plain" / "responses")).count() == 4  # resumed
    run("--provider", "mock", "--dataset", tmp_path / "data.jsonl", "--recipe", tmp_path / "r.json", "--out", tmp_path / "recipe", "--samples", 3)
    assert spark.read.parquet(str(tmp_path / "recipe" / "responses")).groupBy("temperature").count().collect()[0]["count"] == 6
    run("--experiment", tmp_path / "e.json")
    assert spark.read.json(str(tmp_path / "out" / "ablation" / "mixed" / "summary")).first()["total_generated_trajectories"] == 24
    run("--experiment", tmp_path / "e.json", "--dry-run")
    assert "mixed: 6 combinations of 2 samples" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("--dataset", tmp_path / "data.jsonl")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"question": "a", "answer": "#### 1", "id": "1"}\n{bad\n{"question": "a", "answer": "#### 1", "id": "1"}\n')
    stream = ingest.entries(spark, str(tmp_path / "in"), "gsm8k")
    query = ingest.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["id"], r["ground_truth_answer"]) for r in got] == [("1", "1")]


def test_stream_of_responses(spark, tmp_path):
    from cairnflow.streaming import responses

    (tmp_path / "in").mkdir()
    rows = [("r1", "p1", "teacher", "<answer>4</answer>", 5, "2024-01-01T00:01:00"), ("r1", "p1", "teacher", "<answer>4</answer>", 5, "2024-01-01T00:01:00"), ("r2", "p1", "teacher", "5", 3, "2024-01-01T00:02:00"), ("r3", "p2", None, "x", 1, "2024-01-01T00:31:00"), ("late", "p9", "y", "x", 1, "2024-01-01T04:00:00")]
    names = ["response_id", "prompt_id", "persona", "text", "token_count", "made"]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows) + "\n{bad\n")
    truths = spark.createDataFrame([("p1", "4"), ("p2", "x")], "prompt_id string, ground_truth_answer string")
    judged = responses.verified(responses.responses(spark, str(tmp_path / "in")), truths)
    query = ingest.run(responses.correctness(judged), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["persona"], r["total_count"], r["correct_count"], r["tokens"]) for r in got] == [("teacher", 2, 1, 8), ("unknown", 1, 1, 1)]


def test_events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert events.window_totals(e).agg(F.sum("n")).first()[0] == e.count()
    assert events.sessions(e).agg(F.sum("n")).first()[0] == e.count()


def test_run_recipe_and_resume(spark, tmp_path):
    from cairnflow.plans import runner

    source = spark.createDataFrame([("q1", "one"), ("q2", "two")], "id string, user_prompt string")
    truths = spark.createDataFrame([("q1", "5")], "prompt_id string, ground_truth_answer string")
    recipe = grids.Recipe(personas=["analytical", "teacher"], temperatures=[0.5, 1.0])
    for _ in range(2):  # the second finds everything done
        out = runner.run_recipe(source, truths, recipe, generate.MockProvider(), generate.Sampling(seed=3), str(tmp_path / "run"))
    assert out["responses"].count() == 8
    assert {r["n_responses"] for r in out["spectra"].collect()} == {4}
    assert {r["total_count"] for r in out["leaderboard"].collect()} == {4}
    assert out["summary"].first()["num_completed_prompts"] == 2
    composed = grids.jobs(source, recipe).withColumnRenamed("job_id", "id")
    got = runner.report(composed, spark.read.parquet(str(tmp_path / "run" / "responses"))).first()
    assert (got["completed_scheduler"], got["failed"], got["total_responses"]) == (8, 0, 8)


class Bytes:
    eos_token_id = 7

    def encode(self, text):
        return list(text.encode())

    def decode(self, ids):
        return bytes(ids).decode()


class Templated(Bytes):
    def apply_chat_template(self, said, tokenize, add_generation_prompt):
        return "".join(f"{m['role']}:{m['content']}|" for m in said)


def test_tokens(spark):
    from cairnflow.operators import tokens

    rows = tokens.encode(spark.createDataFrame([("héllo",), (None,)], "text string"), Bytes)
    got = tokens.decode(rows, Bytes, to="back").collect()
    assert [(r["token_count"], r["back"]) for r in got] == [(6, "héllo"), (0, "")]
    assert tokens.pad_id(Bytes()) == 7
    two = spark.createDataFrame([("s", "u"), (None, "u")], "system_prompt string, user_prompt string")
    chat = lambda factory, **k: [r["formatted_prompt"] for r in tokens.chat_prompt(two, factory, **k).collect()]
    assert chat(Templated) == ["system:s|user:u|", "user:u|"]
    assert chat(Bytes)[0] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"
    assert chat(Bytes, chatml=False) == ["s\n\nu", "\n\nu"]


def test_optional_libraries(spark):
    from cairnflow.operators.local_models import VLLMProvider
    from cairnflow.sources.hub import scan_hub

    with pytest.raises(generate.ProviderError):
        VLLMProvider("m").open()
    with pytest.raises(ImportError, match="datasets"):
        scan_hub(spark, "x")


def test_sql_functions(spark):
    from cairnflow.functions import sql

    assert "cairn_strip" in sql.register(spark)
    r = spark.sql("SELECT cairn_strip('\t a ') AS s, cairn_words(' a  b ') AS w, cairn_last_number('x 1 y -2.5') AS n, cairn_jaccard(array('a', 'b'), array('b')) AS j, cairn_jaccard(array('a'), filter(array('a'), x -> x = '')) AS z").first()
    assert (r["s"], r["w"], r["n"], r["j"], r["z"]) == ("a", ["a", "b"], "-2.5", 0.5, 0.0)
    from cairnflow.functions import answers, text

    rows = spark.createDataFrame([(x,) for x in ("\u3000 a \t b\r\n\r\n  c\r d ", r"$\(x\)$ 5\% \percent", " 1_0.5e3 ", "1f", "steps #### 42 ", "import  os", "<Answer>x</ANSWER>", "", None)], "x string")
    x = F.col("x")
    pairs = {"cairn_strip(x)": text.strip(x), "cairn_clean_whitespace(x)": text.clean_whitespace(x), "cairn_normalize_math(x)": text.normalize_math(x), "cairn_float(x)": text.python_float(x), "cairn_last_number(x)": answers.last_number(x), "cairn_is_unsafe(x)": answers.unsafe_pattern(x).isNotNull()}
    got = rows.select(*(F.expr(k).eqNullSafe(c).alias(f"c{i}") for i, (k, c) in enumerate(pairs.items()))).collect()
    assert all(all(r) for r in got)
    more = [tuple(r) for r in rows.selectExpr("cairn_gsm8k_answer(x)", "cairn_has_answer(x)").collect()]
    assert more[4] == ("42", False) and more[6][1] and not more[8][1]


def test_metrics_and_ordinals(spark, tmp_path):
    from cairnflow.operators.metrics import RunMetrics

    p = spark.createDataFrame([("1", "ok"), ("2", "bad")], "id string, user_prompt string")
    m = RunMetrics(total=2)
    m.watch(generate.run(p, Flaky(), generate.Sampling())).write.parquet(str(tmp_path / "m"))
    got = m.report()
    assert (got["responses"], got["errors"], got["tokens"], got["progress_percent"]) == (2, 1, 1, 50.0)
    rows = records.with_ordinal(spark.range(100).repartition(7), "id").collect()
    assert all(r["id"] == r["ordinal"] for r in rows)
