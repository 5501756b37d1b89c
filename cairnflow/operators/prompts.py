"""Prompt building: templates, query rewrites, system prompts, chat messages, API payloads."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chatml, fill

# The built-in rewrites, and the system prompt where nothing else is given.
REWRITES = {
    "standard": "Solve the following problem:\n\n{problem}",
    "alternative_method": "Solve the following problem using a less obvious or alternative method:\n\n{problem}",
    "beginner": "Solve the following problem and explain it in simple terms for a beginner:\n\n{problem}",
    "elegant": "Solve the following problem using an elegant mathematical shortcut:\n\n{problem}",
}
DEFAULT_SYSTEM = "You are a helpful mathematical reasoning assistant."

#: (system, user) by name and version; the tags are those that the parsers read.
TEMPLATES = {
    ("default", "v1"): ("Answer the user's question carefully and show how you got there.", "{problem}"),
    ("reasoning", "v1"): ("Put your thoughts between <think> and </think>, and nothing but the result between <answer> and </answer>.", "{problem}"),
    ("math", "v1"): ("You are given a problem of mathematics. Work it out between <think> and </think>, every step of it, and state the resulting number between <answer> and </answer>.", "Problem:\n{problem}"),
}

ASSETS = Path(__file__).parent.parent / "assets"


def register_template(name: str, system: str, user: str, version: str = "v1") -> None:
    TEMPLATES[name, version] = (system, user)


def template(name: str, version: str = "v1") -> tuple[str, str]:
    if (name, version) not in TEMPLATES:
        raise KeyError(f"no template {name!r} {version!r}; there are {sorted(TEMPLATES)}")
    return TEMPLATES[name, version]


def assets(kind: str, folder: Path = ASSETS) -> dict[str, str]:
    """Texts of ``folder``/``kind``/*.md by name: personas, styles, strategies, query_rewrites."""
    return {p.stem: p.read_text(encoding="utf-8").strip() for p in sorted((folder / kind).glob("*.md"))}


def needed(kind: str, names: list[str], folder: Path = ASSETS) -> dict[str, str]:
    """The texts of these names, in their order; FileNotFoundError naming those that have none."""
    there = assets(kind, folder)
    if missing := [n for n in names if n not in there]:
        raise FileNotFoundError(f"no {kind} {missing}; there are {sorted(there)}")
    return {n: there[n] for n in names}


def dimension(spark: SparkSession, texts: dict[str, str], name: str) -> DataFrame:
    """A small table (name, name_text) of assets."""
    return spark.createDataFrame(sorted(texts.items()), f"{name} string, {name}_text string")


def build_chat(entries: DataFrame, system: str, user_template: str, prompt_col: str = "prompt") -> DataFrame:
    """With system_prompt, user_query, formatted_prompt and the two lengths."""
    query = fill(F.lit(user_template), "prompt", F.col(prompt_col))
    return entries.withColumns({"system_prompt": F.lit(system), "user_query": query}).withColumns(
        {
            "formatted_prompt": chatml(F.col("system_prompt"), F.col("user_query")),
            "system_prompt_length": F.length("system_prompt"),
            "user_query_length": F.length("user_query"),
        }
    )


def render(rows: DataFrame, name: str, version: str = "v1", problem_col: str = "problem") -> DataFrame:
    """With system_prompt, user_prompt and template_version of a named template."""
    system, user = template(name, version)
    return rows.withColumns({"system_prompt": F.lit(system), "user_prompt": fill(F.lit(user), "problem", F.col(problem_col)), "template_version": F.lit(version)})


def rewrite(rows: DataFrame, rewrite_col: str = "rewrite", problem_col: str = "raw_user_prompt", extra: dict[str, str] | None = None) -> DataFrame:
    """With user_prompt: the problem in its rewrite's template; default and empty mean standard, unknown ones pass the problem through."""
    known = {**(extra or {}), **REWRITES}
    name = F.when(F.col(rewrite_col).isin("default", ""), F.lit("standard")).otherwise(F.col(rewrite_col))
    texts = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    chosen = F.coalesce(F.try_element_at(texts, name), F.lit("{problem}"))
    return rows.withColumn("user_prompt", fill(chosen, "problem", F.col(problem_col)))


def system_prompt(persona: Column, strategy: Column, style: Column) -> Column:
    """Persona, strategy and style texts, those that are there, a blank line between them; a default if none is."""
    part = lambda x, head: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x))
    whole = F.concat_ws("\n\n", part(persona, ""), part(strategy, "Reasoning Strategy:\n"), part(style, "Format instructions:\n"))
    return F.when(whole == "", F.lit(DEFAULT_SYSTEM)).otherwise(whole)


def compose(jobs: DataFrame, personas: DataFrame, strategies: DataFrame, styles: DataFrame, extra_rewrites: dict[str, str] | None = None) -> DataFrame:
    """Jobs with system_prompt and user_prompt.  The dimensions are asset tables, a row for each file; unknown names count as empty."""
    joined = jobs.join(F.broadcast(personas), "persona", "left").join(F.broadcast(strategies), "strategy", "left").join(F.broadcast(styles), "style", "left")
    whole = joined.withColumn("system_prompt", system_prompt(F.col("persona_text"), F.col("strategy_text"), F.col("style_text")))
    return rewrite(whole, extra=extra_rewrites).drop("persona_text", "strategy_text", "style_text")


def combined_system(persona_text: Column, style_text: Column) -> Column:
    """The experiment's system prompt: nothing is skipped."""
    return F.concat(persona_text, F.lit("\n\nFormat instructions:\n"), style_text)


def messages(system: Column, user: Column) -> Column:
    """array<struct<role, content>>; the system message is left out where it is empty."""
    turn = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return F.filter(F.array(turn("system", F.coalesce(system, F.lit(""))), turn("user", user)), lambda m: (m["role"] == "user") | (m["content"] != ""))


def payload(model: Column, chat: Column, s: Column) -> Column:
    """struct of an API request; optional fields are null, which JSON leaves out, unless they differ from their defaults.

    ``s`` is a sampling struct: temperature, top_p, top_k, min_p, repetition_penalty,
    max_tokens, stop_sequences, seed.
    """
    return F.struct(
        model.alias("model"),
        chat.alias("messages"),
        s["temperature"].alias("temperature"),
        s["top_p"].alias("top_p"),
        s["max_tokens"].alias("max_tokens"),
        F.lit(1).alias("n"),
        F.when(s["top_k"] > 0, s["top_k"]).alias("top_k"),
        F.when(s["min_p"] > 0, s["min_p"]).alias("min_p"),
        F.when(s["repetition_penalty"] != 1, s["repetition_penalty"]).alias("repetition_penalty"),
        F.when(F.size(s["stop_sequences"]) > 0, s["stop_sequences"]).alias("stop"),
        s["seed"].alias("seed"),
    )


def endpoint(url: Column) -> Column:
    """The completions URL of a base URL."""
    done = url.endswith("/chat/completions") | url.endswith("/completions")
    return F.when(done, url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/chat/completions")))


def placeholders(text: str) -> set[str]:
    """Names in braces, for checks of user templates."""
    return set(re.findall(r"\{(\w+)\}", text))
