"""Runs that die and go on, runs of their own, and the steps that commit."""

import json
import os
import signal
import subprocess
import sys
import textwrap
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnflow.operators import generate, prompts
from cairnflow.plans import grids, runner
from cairnflow.session import exists
from cairnflow.streaming import commits


class Asked(generate.MockProvider):
    """Notes in a folder what it is asked for; kills the driver when a prompt is asked for, or fails it."""

    def __init__(self, folder, kill_at=None, pid=0, bad=()):
        self.folder, self.kill_at, self.pid, self.bad = str(folder), kill_at, pid, bad

    def generate(self, system, user, sampling, sample_index):
        if user == self.kill_at:
            os.kill(self.pid, signal.SIGKILL)
            time.sleep(20)  # the workers outlive the driver for a moment, and this one doesn't answer
        with open(os.path.join(self.folder, str(os.getpid())), "a") as f:
            f.write(f"{user}#{sample_index}\n")
        if user in self.bad:
            raise generate.ProviderError("no")
        return super().generate(system, user, sampling, sample_index)


def asked(folder):
    return Counter(line for name in os.listdir(folder) for line in (folder / name).read_text().split())


def prompts_of(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("").alias("system_prompt"), F.concat(F.lit("u"), "id").alias("user_prompt"))


DRIVER = """
    import os, sys
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from cairnflow.operators import generate
    from cairnflow.plans import runner
    import test_runs
    where, out, when = sys.argv[1:]
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    source = test_runs.prompts_of(spark, 40).repartition(10, "id").sortWithinPartitions("id")
    def after(number):
        if when == "after" and number == 2:
            os.kill(os.getpid(), 9)  # its rows are there, the stream's log doesn't know yet
    provider = test_runs.Asked(where, "u39" if when == "within" else None, os.getpid())
    runner.generate_pending(source, provider, generate.Sampling(n=2), runner.Run(out), every=4, after=after)
"""


@pytest.mark.parametrize("when", ["after", "within"])
def test_a_killed_driver_goes_on(spark, tmp_path, when):
    """SIGKILL after some batches: what was committed stays and isn't asked for again, and in the end nothing is lost."""
    where, out = tmp_path / "asked", str(tmp_path / "run")
    where.mkdir()
    (tmp_path / "driver.py").write_text(textwrap.dedent(DRIVER))
    done = subprocess.run([sys.executable, str(tmp_path / "driver.py"), str(where), out, when], capture_output=True, timeout=300)
    assert done.returncode == -signal.SIGKILL, done.stderr[-2000:]
    before = runner.Run.opened(spark, out)
    kept = {(r["prompt_id"], r["sample_index"]) for r in before.responses(spark).collect()}
    first = asked(where)
    assert kept and len(kept) < 80 and max(first.values()) == 1
    if when == "after":
        assert len(kept) == len(first)  # all that was paid for is there
    source = prompts_of(spark, 40)
    rows = runner.generate_pending(source, Asked(where), generate.Sampling(n=2), runner.Run.opened(spark, out), every=1).collect()
    assert Counter((r["prompt_id"], r["sample_index"]) for r in rows) == Counter((f"p{i}", k) for i in range(40) for k in range(2))
    assert {r["run"] for r in rows} == {before.run_id}
    again = asked(where)
    assert all(again[f"u{p[1:]}#{k}"] == 1 for p, k in kept)
    if when == "after":
        assert max(again.values()) == 1


def test_batches_are_played_again_without_repeats(spark, tmp_path):
    """The log of the last batch is lost: it is played again, and finds its rows there; a batch that is half there is completed."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    rows = spark.range(100).withColumn("x", F.col("id") * 2).repartition(10)
    seen = []

    def work(batch):
        seen.append(batch.count())
        return batch.selectExpr("id AS made", "x")

    def stop(number):
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        commits.in_batches(rows, "id", work, out, state, 30, "made", stop)
    assert exists(spark, f"{state}/waiting/_SUCCESS")
    first = spark.read.parquet(out)
    assert first.count() == sum(seen) and len(seen) == 2
    commits.in_batches(rows, "id", work, out, state, 30, "made")
    assert seen[2] == 0  # batch 1, all of it there
    got = spark.read.parquet(out)
    assert sorted(r["made"] for r in got.collect()) == list(range(100)) and got.where("x <> 2 * made").count() == 0
    assert got.select("batch").distinct().count() == len(seen) - 1
    assert not exists(spark, state)
    commits.in_batches(rows.limit(0), "id", work, str(tmp_path / "none"), state, 30)
    assert not exists(spark, str(tmp_path / "none")) and not exists(spark, state)


def test_a_run_without_resume_is_its_own(spark, tmp_path):
    source = prompts_of(spark, 3)
    truths = source.select(F.col("id").alias("prompt_id"), F.lit("1").alias("ground_truth_answer"))
    run = lambda **k: runner.run_prompts(source, truths, generate.MockProvider(), generate.Sampling(n=2), str(tmp_path / "r"), **k)
    ids = []
    for how in ({}, {"resume": False}, {}):
        out = run(**how)
        assert [r["n_responses"] for r in out["spectra"].collect()] == [2, 2, 2]
        assert out["summary"].first()["total_generated_trajectories"] == 6
        assert out["report"].first()["total_responses"] == 6
        ids.append([r["response_id"] for r in out["responses"].collect()])
        assert len(ids[-1]) == 6
    ids = [set(x) for x in ids]
    assert not ids[0] & ids[1] and ids[1] == ids[2]  # the last goes on with the latest
    stored = spark.read.parquet(str(tmp_path / "r" / "responses"))
    assert stored.count() == 12 and stored.select("response_id").distinct().count() == 12
    assert not os.listdir(tmp_path / "r" / "rounds")


def test_failed_prompts_are_asked_for_again(spark, tmp_path):
    where = tmp_path / "asked"
    where.mkdir()
    source, run = prompts_of(spark, 4), runner.Run(str(tmp_path / "r"))
    runner.generate_pending(source, Asked(where, bad=("u1",)), generate.Sampling(), run)
    rows = runner.generate_pending(source, Asked(where), generate.Sampling(), run)
    assert asked(where) == Counter({"u0#0": 1, "u1#0": 2, "u2#0": 1, "u3#0": 1})
    assert rows.where("error is null").count() == 4
    got = runner.report(source, rows).first()
    assert (got["completed_scheduler"], got["failed"], got["total_responses"]) == (4, 0, 4)


def test_samples_of_a_seed_are_no_copies(spark, tmp_path):
    source = prompts_of(spark, 1)
    recipe = grids.Recipe(seeds=[7], samples_per_configuration=3)
    truths = source.select(F.col("id").alias("prompt_id"), F.lit("1").alias("ground_truth_answer"))
    out = runner.run_recipe(source, truths, recipe, generate.MockProvider(), generate.Sampling(n=8), str(tmp_path / "r"))
    rows = out["responses"].collect()
    assert len(rows) == 3 and len({r["text"] for r in rows}) == 3 and {r["seed"] for r in rows} == {7, 8, 9}
    assert [len(r["responses"]) for r in out["spectra"].collect()] == [3]


def test_missing_personas_raise_before_anything(spark, tmp_path):
    experiment = grids.Experiment(name="e", output_dir=str(tmp_path / "out"), recipes={"r": grids.ExperimentRecipe(personas=["nobody"], styles=["standard"]), "s": grids.ExperimentRecipe(personas=["teacher"], styles=["none"])})
    for name, said in (("r", "nobody"), ("s", "none")):
        with pytest.raises(FileNotFoundError, match=said):
            runner.run_experiment(prompts_of(spark, 1), prompts_of(spark, 1), experiment, name, generate.MockProvider(), generate.Sampling())
    assert not (tmp_path / "out").exists()
    assert list(prompts.needed("personas", ["teacher", "analytical"])) == ["teacher", "analytical"]


def test_prompts_are_dealt_by_sampling(spark):
    """Slices of one sampling lie in one task, also of a sampling that most prompts have."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, 0.5).otherwise(1.0).alias("temperature"))
    got = generate.dealt(rows, size=16).withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).orderBy("place").collect()
    assert sorted(int(r["id"]) for r in got) == list(range(4000))
    tasks = Counter(r["task"] for r in got)
    assert len(tasks) > 8 and max(tasks.values()) < 800
    changes = sum(a["task"] == b["task"] and a["temperature"] != b["temperature"] for a, b in zip(got, got[1:]))
    assert changes <= len(tasks)


def test_settings_nothing_uses_are_warned_of(tmp_path, caplog):
    from cairnflow.sources import config

    (tmp_path / "e.json").write_text(json.dumps({"storage": {"format": "jsonl", "output_dir": "o"}, "provider": {"type": "vllm", "model_path": "m", "dtype": "auto", "max_model_len": None}}))
    with caplog.at_level("WARNING"):
        got = config.engine(tmp_path / "e.json")
    assert "format" in caplog.text and "dtype" not in caplog.text and got.storage.output_dir == "o"
    assert got.provider.local_model() == ("m", {"dtype": "auto"})


@pytest.mark.parametrize("files", [1, 4])
def test_first_rows_of_a_shuffled_stream(spark, tmp_path, files):
    """A stream of shuffled files: each id's first row in the end, whatever came before it, as in one batch."""
    import random

    from cairnflow.operators import records
    from cairnflow.streaming import first_wins

    rng = random.Random(files)
    rows = [{"id": rng.choice(["hot", *(f"i{k}" for k in range(30))]), "ordinal": k, "prompt": f"p{k}"} for k in range(400)]
    shuffled = rng.sample(rows, len(rows))
    (tmp_path / "in").mkdir()
    for n in range(files):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in shuffled[n::files]))
    kind = "id string, ordinal long, prompt string"
    before = {k: spark.conf.get(k, None) for k in first_wins.STORE}
    for k, v in first_wins.STORE.items():
        spark.conf.set(k, v)
    try:
        for _ in range(2):  # the second goes on and finds nothing new
            stream = first_wins.first_wins(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted(tuple(r) for r in first_wins.current(spark, str(tmp_path / "out")).select("id", "ordinal", "prompt").collect())
    assert got == sorted(tuple(r) for r in records.dedup_first(spark.createDataFrame(rows, kind)).collect())
    given = spark.read.parquet(str(tmp_path / "out")).count()
    assert given == len(got) if files == 1 else len(got) < given < len(rows)
