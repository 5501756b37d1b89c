"""Runs over a prompt file, or an experiment.

    python -m cairnflow --config FILE --dataset FILE --out FOLDER [--provider api|vllm|transformers|mock] [--recipe FILE]
    python -m cairnflow --experiment FILE [--dataset FILE] [--out FOLDER]

With ``--dry-run`` the plan and its counts are shown and nothing is generated.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import functions as F

from .operators import prompts
from .plans import grids, runner
from .session import session, setup_logging
from .sources import config, readers


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnflow", description="Generate, verify and report reasoning trajectories.")
    p.add_argument("--config", help="settings of provider, sampling, scheduler, storage, logging and prompts")
    p.add_argument("--provider", choices=["api", "http", "vllm", "transformers", "mock"], help="in place of the settings' type")
    p.add_argument("--dataset")
    p.add_argument("--recipe", help="a recipe file; without one every prompt is generated as it is")
    p.add_argument("--experiment")
    p.add_argument("--out", help="the run's folder")
    p.add_argument("--samples", type=int, help="in place of the sampling's n; with a recipe, responses of each of its jobs (1)")
    p.add_argument("--verifier", default="math")
    p.add_argument("--no-resume", action="store_true", help="a run of its own, beside what the folder holds")
    p.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    p = arguments()
    given = p.parse_args(argv)
    experiment = config.experiment(given.experiment) if given.experiment else None
    file = given.config or (experiment and experiment.provider_config_path)
    settings = config.engine(file) if file else config.Engine()
    dataset = given.dataset or (experiment and experiment.dataset_path)
    if not dataset:
        p.error("a dataset is needed")
    if experiment is None and not given.config and given.provider is None:
        p.error("--config or --provider is needed")
    if given.samples:
        settings.sampling.n = given.samples
    setup_logging(getattr(logging, settings.logging.level.upper(), logging.INFO), settings.logging.file)
    spark = session()
    if experiment:
        for kind in ("personas", "styles"):  # before anything is read or paid for
            prompts.needed(kind, sorted({x for r in experiment.recipes.values() for x in getattr(r, kind)}))
    source = readers.scan_prompts(spark, dataset, settings.prompts.system_prompt)
    recipe = config.recipe(given.recipe) if given.recipe else None
    if given.dry_run:
        show_plan(source, recipe, experiment)
        return
    provider = config.provider(settings.provider, given.provider)
    truth = F.coalesce(readers.truthy(F.col("metadata"), "answer"), readers.truthy(F.col("metadata"), "ground_truth"))
    tests = F.coalesce(F.try_variant_get("metadata", "$.test_cases", "array<string>"), F.array().cast("array<string>"))
    truths = source.select(F.col("id").alias("prompt_id"), truth.alias("ground_truth_answer"), tests.alias("assertions"))
    options = {"concurrency": settings.provider.max_concurrent, "batch_size": settings.scheduler.batch_size, "progress": settings.scheduler.progress_interval, "every": settings.scheduler.checkpoint_interval, "resume": not given.no_resume}
    folder = given.out or (experiment.output_dir if experiment else settings.storage.output_dir)
    if experiment:
        for name in experiment.recipes:
            show(runner.run_experiment(source, truths, experiment, name, provider, settings.sampling, folder, **options))
    elif recipe:
        show(runner.run_recipe(source, truths, recipe, provider, settings.sampling, folder, verifier_type=given.verifier, samples=given.samples or 1, **options))
    else:
        show(runner.run_prompts(source, truths, provider, settings.sampling, folder, given.verifier, **options))


def show_plan(source, recipe, experiment) -> None:
    print(f"{source.count()} prompts")
    if recipe:
        jobs = grids.jobs(source, recipe)
        print(f"{len(recipe.combinations())} combinations, {jobs.count()} jobs")
        jobs.explain("formatted")
    for name, r in experiment.recipes.items() if experiment else ():
        print(f"{name}: {len(r.personas) * len(r.styles) * len(r.temperatures) * len(r.seeds)} combinations of {r.samples_per_configuration} samples")


def show(out: dict) -> None:
    out["leaderboard"].show(50, False)
    out.get("report", out["summary"]).show(1, False)


if __name__ == "__main__":
    main()
