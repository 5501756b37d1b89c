"""Declarative grids of generation jobs: axes are small and live on the driver, prompts are a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import float_repr


@dataclass
class Recipe:
    """Axes of a recipe; an empty axis stands for its default: default personas and strategies, standard styles and rewrites."""

    name: str = "recipe"
    version: str = "v1"
    personas: list[str] = field(default_factory=list)
    strategies: list[str] = field(default_factory=list)
    styles: list[str] = field(default_factory=list)
    query_rewrites: list[str] = field(default_factory=list)
    temperatures: list[float] = field(default_factory=list)
    top_p: list[float] = field(default_factory=list)
    seeds: list[int | None] = field(default_factory=list)
    samples_per_configuration: int = 1

    def combinations(self) -> list[tuple]:
        """In grid order, the last axis fastest, samples innermost."""
        axes = (self.personas or ["default"], self.strategies or ["default"], self.styles or ["standard"], self.query_rewrites or ["standard"], self.temperatures or [1.0], self.top_p or [1.0], self.seeds or [None], range(self.samples_per_configuration))
        return [tuple(x) for x in product(*axes)]


@dataclass
class ExperimentRecipe:
    """Axes of an experiment's recipe; without personas or styles it has no prompts."""

    personas: list[str] = field(default_factory=list)
    styles: list[str] = field(default_factory=list)
    temperatures: list[float] = field(default_factory=lambda: [1.0])
    seeds: list[int | None] = field(default_factory=lambda: [None])
    samples_per_configuration: int = 1


@dataclass
class Experiment:
    """Recipes that share a provider, a dataset and a verifier."""

    name: str = "experiment"
    provider_config_path: str = ""
    dataset_path: str = ""
    output_dir: str = "./outputs/experiments"
    verifier_type: str = "math"
    recipes: dict[str, ExperimentRecipe] = field(default_factory=dict)


GRID = "combo int, persona string, strategy string, style string, rewrite string, temperature double, top_p double, seed long, sample_index int, suffix string"


def jobs(prompts: DataFrame, recipe: Recipe, id_col: str = "id", prompt_col: str = "user_prompt") -> DataFrame:
    """One job for each prompt and combination, with job_id and combo, its place in the grid.

    The grid's size doesn't follow the data, so it is broadcast; each prompt's jobs are made
    where the prompt is, without a shuffle.
    """
    rows = []
    for n, (persona, strategy, style, rewrite, t, p, seed, k) in enumerate(recipe.combinations()):
        suffix = f"_{persona}_{strategy}_{style}_{rewrite}_t{float_repr(t)}_p{float_repr(p)}_s{seed}_idx{k}"
        rows.append((n, persona, strategy, style, rewrite, float(t), float(p), seed, k, suffix))
    grid = prompts.sparkSession.createDataFrame(rows, GRID)
    crossed = prompts.select(prompts[id_col].cast("string").alias("prompt_id"), prompts[prompt_col].alias("raw_user_prompt")).crossJoin(F.broadcast(grid))
    return crossed.withColumn("job_id", F.concat("prompt_id", "suffix")).drop("suffix")


def experiment(prompts: DataFrame, personas: dict[str, str], styles: dict[str, str], temperatures: list[float], seeds: list[int | None], id_col: str = "id", prompt_col: str = "user_prompt") -> DataFrame:
    """An experiment's prompts: personas by styles by temperatures by seeds, with composed ids and system prompts.

    An empty axis gives no rows at all.
    """
    rows = [
        (n, persona, style, float(t), seed, f"_{persona}_{style}_t{float_repr(t)}_s{seed}", f"{personas[persona]}\n\nFormat instructions:\n{styles[style]}")
        for n, (persona, style, t, seed) in enumerate(product(personas, styles, temperatures, seeds))
    ]
    grid = prompts.sparkSession.createDataFrame(rows, "combo int, persona string, style string, temperature double, seed long, suffix string, system_prompt string")
    crossed = prompts.select(prompts[id_col].cast("string").alias("base_prompt_id"), prompts[prompt_col].alias("user_prompt")).crossJoin(F.broadcast(grid))
    return crossed.withColumn("id", F.concat("base_prompt_id", "suffix")).drop("suffix")


def sampling_groups(job_rows: DataFrame, batch: int = 16) -> DataFrame:
    """Jobs per sampling key, a null seed being one of its own, and how many batches of ``batch`` they make."""
    return job_rows.groupBy("temperature", "top_p", "seed").agg(F.count("*").alias("n_jobs"), F.ceil(F.count("*") / batch).cast("long").alias("n_batches"))
