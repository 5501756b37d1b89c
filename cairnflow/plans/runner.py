"""Whole runs: prompts to responses, recipes and experiments to verified spectra, a leaderboard and a summary.

Responses are appended in committed micro-batches before anything reads them, so a driver
that dies loses the batch in hand at most, and a lost executor never makes a prompt be
generated twice by a later step.  Finished ids are read back from the responses: a run that
stopped goes on where it was.  A run without resume is a run of its own: it has its own
responses, spectra and ids, and an earlier one in the folder stays as it is.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import generate, prompts, trajectories, verifiers
from ..operators.metrics import RunMetrics
from ..session import checkpointed
from ..sources import readers
from ..streaming import commits
from . import grids

log = logging.getLogger(__name__)

RESPONSES = f"{generate.RESPONSES}, run string, round string, batch int"


def stamp() -> str:
    """A name that sorts by the time it was made."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"


@dataclass
class Run:
    """Where a run's tables lie: responses (by run, round and batch), spectra (JSON lines, by run), finished ids, summary."""

    folder: str
    run_id: str = field(default_factory=stamp)

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, resume: bool = True) -> Run:
        """The latest run of a folder, or a new one where there is none or it isn't to be resumed."""
        there = cls(folder).stored(spark) if resume else None
        last = there.agg(F.max("run")).first()[0] if there is not None else None
        return cls(folder) if last is None else cls(folder, last)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def stored(self, spark: SparkSession) -> DataFrame | None:
        """Responses of all of the folder's runs; None where there are none."""
        try:
            return spark.read.schema(RESPONSES).parquet(self.path("responses"))
        except AnalysisException:
            return None

    def responses(self, spark: SparkSession) -> DataFrame:
        """This run's responses; other runs' folders aren't read."""
        there = self.stored(spark)
        return spark.createDataFrame([], RESPONSES) if there is None else there.where(F.col("run") == self.run_id)


def generate_pending(
    wanted: DataFrame, provider: generate.Provider, sampling: generate.Sampling, run: Run, every: int = 50, after: Callable[[int], None] | None = None, batch_size: int = 16, **options
) -> DataFrame:
    """Generate for the prompts (id, system_prompt, user_prompt, and a sampling of their own) that have no good response yet; all responses of the run.

    Responses are committed when some ``every`` prompts for each of the cluster's slots are done, then
    ``after`` is called with the batch's number.  Within a batch prompts of one sampling go to the provider
    together.  Other options are those of :func:`..operators.generate.run`.
    """
    spark = wanted.sparkSession
    wanted = wanted.withColumn("id", F.col("id").cast("string"))
    done = run.responses(spark).where("error is null").select(F.col("prompt_id").alias("id")).distinct()
    name, told = stamp(), []

    def work(batch: DataFrame) -> DataFrame:
        told.append(RunMetrics())
        made = generate.run(generate.dealt(batch, size=batch_size), provider, sampling, batch_size=batch_size, run_id=run.run_id, **options)
        return told[-1].watch(made)

    def committed(number: int) -> None:
        log.info("batch %d committed: %s", number, told[-1].report())
        if after is not None:
            after(number)

    every = every * spark.sparkContext.defaultParallelism
    commits.in_batches(trajectories.pending(wanted, done), "id", work, f"{run.path('responses')}/run={run.run_id}/round={name}", run.path(f"rounds/{name}"), every, "prompt_id", committed)
    return run.responses(spark)


def report(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """A run's report: a prompt with a good response is completed, one with errors alone failed, one without any skipped."""
    each = responses.groupBy("prompt_id").agg(
        F.count_if(F.col("error").isNull()).alias("n_responses"),
        F.sum("token_count").alias("n_tokens"),
        (F.sum("latency_ms") / 1000).alias("elapsed"),
    )
    joined = wanted.select(F.col("id").alias("prompt_id")).join(each, "prompt_id", "left")
    status = F.when(F.col("n_responses") > 0, "completed").when(F.col("n_responses") == 0, "failed").otherwise("skipped")
    return trajectories.run_report(joined.withColumn("status", status))


def verified(responses: DataFrame, jobs: DataFrame, truths: DataFrame, verifier_type: str = "math") -> DataFrame:
    """Good responses with what ``jobs`` (job_id, prompt_id, …) says of theirs, parsed fields and the verdict of a verifier.

    truths are (prompt_id, ground_truth_answer) and, for code, assertions.  A prompt without a
    truth is held against an empty one.  extracted_answer is the provider's.
    """
    good = responses.where("error is null").withColumnRenamed("prompt_id", "job_id")
    joined = good.join(jobs, "job_id").join(truths, "prompt_id", "left")
    return verifiers.verify(joined, verifier_type).withColumn("extracted_answer", answers.provider_answer(F.col("text")))


#: What a nested spectrum states of each response.
RESPONSE = ["response_id", "job_id", "persona", "sample_index", "text", "thinking_trace", "extracted_answer", "reasoning_length_chars", "is_correct", "verify_error", "token_count", "finish_reason", "latency_ms", "temperature", "top_p", "seed"]


def spectra(judged: DataFrame, source: DataFrame, recipe: str, sampling: generate.Sampling) -> tuple[DataFrame, DataFrame]:
    """(spectra, diversity): for each prompt its responses in order, verdict counts, diversity, timing, sampling and origin."""
    nested = trajectories.spectra(judged, "prompt_id", "place", RESPONSE)
    counts = trajectories.correctness(judged, "prompt_id")
    timing = judged.groupBy("prompt_id").agg(
        F.struct((F.sum("latency_ms") / 1000).alias("latency_seconds"), F.sum("token_count").alias("total_tokens"), F.when(F.sum("latency_ms") > 0, F.sum("token_count") * 1000 / F.sum("latency_ms")).otherwise(F.lit(0.0)).alias("tokens_per_second")).alias("timing"),
        F.min(F.struct("provider", "model")).alias("provider_info"),
    )
    diversity = trajectories.diversity(judged, "prompt_id", "place")
    told = diversity.select("prompt_id", F.struct(*(c for c in diversity.columns if c != "prompt_id")).alias("diversity_statistics"))
    metadata = F.struct(F.lit(recipe).alias("recipe_name"), F.col("total").alias("total_candidates"), F.col("correct").alias("correct_candidates"), F.col("incorrect").alias("incorrect_candidates"), F.col("ratio").alias("correctness_ratio"))
    config = F.struct(*(F.lit(v).alias(k) for k, v in (("temperature", sampling.temperature), ("top_p", sampling.top_p), ("top_k", sampling.top_k), ("min_p", sampling.min_p), ("repetition_penalty", sampling.repetition_penalty), ("max_tokens", sampling.max_tokens), ("n", sampling.n))))
    own = source.select(F.col("id").alias("prompt_id"), F.struct("id", "user_prompt").alias("prompt"))
    whole = nested.join(counts, "prompt_id").join(told, "prompt_id").join(timing, "prompt_id").join(own, "prompt_id", "left")
    return whole.select("prompt_id", "prompt", "n_responses", "responses", metadata.alias("metadata"), "diversity_statistics", "timing", config.alias("sampling"), "provider_info"), diversity


def written(judged: DataFrame, source: DataFrame, name: str, sampling: generate.Sampling, run: Run, experiment: str | None = None) -> dict[str, DataFrame]:
    """Spectra and summary of all that a run holds, written to its folder; the summary, the folder's latest, has the leaderboard in it."""
    spark = source.sparkSession
    judged = checkpointed(judged)  # parsed and verified once, for all that is told of it
    nested, diversity = spectra(judged, source, name, sampling)
    own = f"{run.path('spectra')}/run={run.run_id}"
    nested.write.mode("overwrite").json(own)
    board = trajectories.leaderboard(judged, order="place")
    listed = board.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "persona", "correctness", "correct_count", "total_count", "avg_tokens"))), lambda r: r.dropFields("place")).alias("persona_leaderboard"))
    totals = trajectories.recipe_summary(judged, diversity, "prompt_id").select(F.lit(name).alias("recipe"), F.lit(experiment).alias("experiment"), "*")
    summary = totals.crossJoin(listed)  # one row each
    readers.write_summary(summary, run.path("summary"))
    return {"responses": judged, "spectra": spark.read.json(own), "leaderboard": board, "summary": summary, "diversity": diversity}


def run_recipe(source: DataFrame, truths: DataFrame, recipe: grids.Recipe, provider: generate.Provider, sampling: generate.Sampling, folder: str, extra_rewrites: dict[str, str] | None = None, verifier_type: str = "math", resume: bool = True, samples: int = 1, **options) -> dict[str, DataFrame]:
    """Plan, generate, verify and report a recipe for prompts (id, user_prompt).

    Every job is generated at its own temperature, top_p and seed; ``sampling`` has the rest but
    its n: a job has one response, as the recipe's samples are jobs of their own, or ``samples``.
    A seeded job asks with its seed plus its sample's number, so samples are no copies.
    Gives responses, spectra, leaderboard, diversity and summary; spectra and summary are
    written to the folder as well, over all of the run, what it had before it was resumed included.
    """
    spark, sampling = source.sparkSession, generate.replace(sampling, n=samples)
    run = Run.opened(spark, folder, resume)
    jobs = grids.jobs(source, recipe)
    dims = [prompts.dimension(spark, prompts.assets(kind), name) for kind, name in (("personas", "persona"), ("strategies", "strategy"), ("styles", "style"))]
    composed = prompts.compose(jobs, *dims, extra_rewrites=extra_rewrites).withColumnRenamed("job_id", "id").withColumn("seed", F.col("seed") + F.col("sample_index") * samples)
    responses = generate_pending(composed, provider, sampling, run, **options)
    told = jobs.select("job_id", "prompt_id", "persona", (F.col("combo") * sampling.n).alias("first"))
    judged = verified(responses, told, truths, verifier_type).withColumn("place", F.col("first") + F.col("sample_index"))
    return written(judged, source, recipe.name, sampling, run)


def run_experiment(source: DataFrame, truths: DataFrame, experiment: grids.Experiment, name: str, provider: generate.Provider, sampling: generate.Sampling, folder: str | None = None, resume: bool = True, **options) -> dict[str, DataFrame]:
    """One recipe of an experiment: personas by styles by temperatures by seeds, each with its samples, to the recipe's own folder.

    Prompts that have their responses are passed over; the summary covers all of the run.
    KeyError for a recipe that the experiment hasn't, FileNotFoundError for a persona or a
    style without a text, both before anything is generated.
    """
    if name not in experiment.recipes:
        raise KeyError(f"no recipe {name!r}; there are {sorted(experiment.recipes)}")
    recipe = experiment.recipes[name]
    personas, styles = prompts.needed("personas", recipe.personas), prompts.needed("styles", recipe.styles)
    run = Run.opened(source.sparkSession, f"{folder or experiment.output_dir}/{experiment.name}/{name}", resume)
    config = generate.replace(sampling, n=recipe.samples_per_configuration)
    grid = grids.experiment(source, personas, styles, recipe.temperatures, recipe.seeds)
    responses = generate_pending(grid, provider, config, run, **options)
    told = grid.select(F.col("id").alias("job_id"), F.col("base_prompt_id").alias("prompt_id"), "persona", "style", (F.col("combo") * config.n).alias("first"))
    judged = verified(responses, told, truths, experiment.verifier_type).withColumn("place", F.col("first") + F.col("sample_index"))
    return written(judged, source, name, config, run, experiment.name)


def run_prompts(source: DataFrame, truths: DataFrame, provider: generate.Provider, sampling: generate.Sampling, folder: str, verifier_type: str = "math", job_id: str = "default", resume: bool = True, **options) -> dict[str, DataFrame]:
    """A plain run over prompts (id, system_prompt, user_prompt): responses, spectra, finished ids by ``job_id`` and run, and a report."""
    spark = source.sparkSession
    run = Run.opened(spark, folder, resume)
    responses = generate_pending(source, provider, sampling, run, **options)
    told = source.select(F.col("id").cast("string").alias("job_id"), F.col("id").cast("string").alias("prompt_id"), F.lit(None).cast("string").alias("persona"))
    judged = verified(responses, told, truths, verifier_type).withColumn("place", F.col("sample_index"))
    out = written(judged, source, job_id, sampling, run)
    done = readers.Checkpoint(spark, run.path("completed"), f"{job_id}@{run.run_id}")
    done.mark(trajectories.pending(responses.where("error is null").select(F.col("prompt_id").alias("id")), done.completed()))
    return out | {"report": report(source, responses)}
