"""Trajectories: resume, diversity, correctness, leaderboards, rewards, nested spectra, run reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, word_set
from ..session import checkpointed
from .aggregates import MeanCosine, aggregated


def completed_ids(*sources: DataFrame) -> DataFrame:
    """Distinct ids of any number of (id) tables: checkpoint, sink."""
    out = sources[0].select("id")
    for s in sources[1:]:
        out = out.union(s.select("id"))
    return out.distinct()


def pending(rows: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id isn't done; repeated rows stay."""
    return rows.join(done.select(F.col("id").alias(id_col)), id_col, "left_anti")


#: Distinct word sets of one share of a group.
SHARE = 512


#: Words of two parts that are compared at a time.
WIDTH = 2048


def similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, s): for each pair of parts, from rows sorted by it, the sum of its pairs' Jaccard similarities, each times both counts."""
    now, sides = None, ([], [])
    for batch in batches:
        kind = batch.schema.field("g").type
        out: list[tuple] = []
        for r in (r for k in range(0, batch.num_rows, SHARE) for r in batch.slice(k, SHARE).to_pylist()):
            key = (r["g"], r["i"], r["j"])
            if key != now:
                if now is not None:
                    out.append((now[0], similarity(*sides, now[1] == now[2])))
                now, sides = key, ([], [])
            sides[r["side"]].append((r["w"], r["c"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], kind), pa.array([s for _, s in out], pa.float64())], ["g", "s"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([similarity(*sides, now[1] == now[2])])], ["g", "s"])


def similarity(a: list[tuple[list[str], int]], b: list[tuple[list[str], int]], same: bool) -> float:
    """Summed over the pairs of two lists of (word set, count), or of one list with itself; products of incidence matrices count the words that sets share."""
    b = a if same else b
    if not a or not b:
        return 0.0
    seen: dict[str, list[tuple[int, int]]] = {}
    for side, sets in enumerate((a,) if same else (a, b)):
        for n, (words, _) in enumerate(sets):
            for w in words:
                seen.setdefault(w, []).append((side, n))
    both = [at for at in seen.values() if len(at) > 1]  # the others are shared by no pair
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    for k in range(0, len(both), WIDTH):
        x, y = np.zeros((len(a), WIDTH), dtype=np.float32), np.zeros((len(b), WIDTH), dtype=np.float32)
        for column, at in enumerate(both[k : k + WIDTH]):
            for side, n in at:
                (y if side else x)[n, column] = 1
        common += x @ (x if same else y).T
    sizes = [np.array([len(w) for w, _ in s], dtype=np.float64) for s in (a, b)]
    counts = [np.array([c for _, c in s], dtype=np.float64) for s in (a, b)]
    shares = common / (sizes[0][:, None] + sizes[1][None, :] - common)
    if same:
        np.fill_diagonal(shares, 0.0)
    return float(counts[0] @ shares @ counts[1]) / (2 if same else 1)


def pairwise_jaccard(rows: DataFrame, group: str, order: str, text: str = "text") -> DataFrame:
    """(group, n_texts, avg_jaccard): the mean over pairs of the texts' word sets; 0 below two texts.

    Texts with equal word sets stand once for their count, so copies make no pairs.  The mean
    needs every two distinct sets of a group compared; a group of more than SHARE of them is
    dealt in pairs of parts, so no task has more than SHARE squared comparisons of a group at
    a time.  Pairs are no rows anywhere: only their sums leave a task.
    """
    sets = rows.select(F.col(group).alias("g"), F.array_sort(word_set(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    # written once, as sizes, parts and both sides of the join come of it; empty sets have no pairs, but count
    every = checkpointed(sets.groupBy("g", "w").agg(F.count("*").alias("c")))
    sizes = every.groupBy("g").agg(F.sum("c").alias("n_texts"), F.ceil(F.count_if(F.size("w") > 0) / SHARE).cast("int").alias("parts"))
    kinds = every.where(F.size("w") > 0)
    large = sizes.where("parts > 1").select("g", "parts")
    dealt = kinds.join(large, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("w"), F.col("parts")).cast("int"))
    # a pair of parts meets once, the lower one on the left; a part that meets itself is there once
    left = F.transform(F.sequence(F.col("mine"), F.col("parts") - 1), lambda k: F.struct(F.col("mine").alias("i"), k.alias("j"), F.lit(0).alias("side")))
    right = F.transform(F.filter(F.sequence(F.lit(0), F.col("mine")), lambda k: k < F.col("mine")), lambda k: F.struct(k.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side")))
    cells = dealt.select("g", "w", "c", F.explode(F.concat(left, right)).alias("m")).select("g", "m.i", "m.j", "m.side", "w", "c")
    kind = rows.schema[group].dataType.simpleString()
    shared = cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side").mapInArrow(similarities, f"g {kind}, s double")
    same = kinds.where("c > 1").select("g", (F.col("c") * (F.col("c") - 1) / 2).alias("s"))
    total = shared.union(same).groupBy("g").agg(F.sum("s").alias("s"))
    n = F.col("n_texts")
    mean = F.when(n > 1, F.coalesce("s", F.lit(0.0)) / (n * (n - 1) / 2)).otherwise(F.lit(0.0))
    return sizes.join(total, "g", "left").select(F.col("g").alias(group), "n_texts", mean.alias("avg_jaccard"))


def semantic_similarity(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n_vectors, avg_cosine): the mean cosine over pairs of a group's vectors; 0 below two.

    The sum of u * v over all pairs of unit vectors is (|sum of u|^2 - n) / 2, so one pass of
    sums does, which are added up in each task first (:class:`.aggregates.MeanCosine`); a hot
    group is no more than a vector from each.  A vector that is null, zero, or holds a null or a value that isn't finite has no
    direction, and vectors of different lengths have no angle: such pairs count as 0.
    """
    return aggregated(rows, group, MeanCosine(vector))


def diversity(rows: DataFrame, group: str, order: str, text: str = "text", answer: str = "extracted_answer", tokens: str = "token_count", vector: str | None = None) -> DataFrame:
    """Lexical diversity of each group: counts, lengths, token counts of rows that have tokens, mean Jaccard and score.

    avg_semantic is the mean cosine of the column ``vector``, or without one the mean Jaccard again.
    """
    some = F.when(F.col(tokens) > 0, F.col(tokens))
    stats = rows.groupBy(group).agg(
        F.count("*").alias("total_responses"),
        F.count_distinct(text).alias("unique_texts"),
        F.count_distinct(answer).alias("unique_answers"),
        F.avg(F.length(text)).alias("avg_chars"),
        F.min(F.length(text)).alias("min_chars"),
        F.max(F.length(text)).alias("max_chars"),
        F.coalesce(F.avg(some), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.min(some), F.lit(0)).cast("long").alias("min_tokens"),
        F.coalesce(F.max(some), F.lit(0)).cast("long").alias("max_tokens"),
    )
    jaccard = pairwise_jaccard(rows, group, order, text).select(group, "avg_jaccard")
    score = F.col("unique_answers") / F.col("total_responses") * (1 - F.col("avg_jaccard"))
    joined = stats.join(jaccard, group)
    if vector is not None:
        joined = joined.join(semantic_similarity(rows, group, vector).select(group, F.col("avg_cosine").alias("avg_semantic")), group)
    else:
        joined = joined.withColumn("avg_semantic", F.col("avg_jaccard"))
    return joined.withColumns({"duplicates": F.col("total_responses") - F.col("unique_texts"), "diversity_score": score})


def correctness(rows: DataFrame, group: str, verdict: str = "is_correct") -> DataFrame:
    """total, correct (true alone), incorrect and ratio of each group."""
    right = F.count_if(F.col(verdict).eqNullSafe(True))
    return rows.groupBy(group).agg(F.count("*").alias("total"), right.alias("correct"), (F.count("*") - right).alias("incorrect"), (right / F.count("*")).alias("ratio"))


def percent(x: Column) -> Column:
    """A share as Python's .1% prints it."""
    return F.concat(fixed(x * 100, 1), F.lit("%"))


def leaderboard(rows: DataFrame, persona: str = "persona", verdict: str = "is_correct", tokens: str = "token_count", order: str = "ordinal") -> DataFrame:
    """Per persona: correctness as text, counts, whole average tokens; place is the order of first appearance, not a ranking."""
    who = F.coalesce(F.col(persona), F.lit("unknown"))
    right = F.count_if(F.col(verdict).eqNullSafe(True))
    board = rows.groupBy(who.alias("persona")).agg(
        (right / F.count("*")).alias("rate"), right.alias("correct_count"), F.count("*").alias("total_count"), F.avg(tokens).cast("long").alias("avg_tokens"), F.min(order).alias("first")
    )
    # a row for each persona, so one partition holds them
    return board.select("persona", percent(F.col("rate")).alias("correctness"), "correct_count", "total_count", "avg_tokens", F.row_number().over(Window.orderBy("first")).alias("place"))


def recipe_summary(rows: DataFrame, scores: DataFrame, prompt: str, verdict: str = "is_correct") -> DataFrame:
    """One row: prompts, trajectories, correctness as text, and the mean diversity score as text."""
    right = F.count_if(F.col(verdict).eqNullSafe(True))
    n = F.count("*")
    totals = rows.agg(F.count_distinct(prompt).alias("num_completed_prompts"), n.alias("total_generated_trajectories"), F.when(n > 0, percent(right / n)).otherwise("0.0%").alias("overall_trajectory_correctness"))
    mean = scores.agg(fixed(F.coalesce(F.avg("diversity_score"), F.lit(0.0)), 3).alias("average_lexical_diversity"))
    return totals.crossJoin(mean)  # one row each


def spectra(responses: DataFrame, prompt_id: str, order: str, fields: list[str]) -> DataFrame:
    """One row per prompt with its responses nested in order.  A spectrum is a record by nature; its size is a prompt's number of samples."""
    nested = F.array_sort(F.collect_list(F.struct(F.col(order).alias("ordinal"), *fields)))
    return responses.groupBy(prompt_id).agg(F.count("*").alias("n_responses"), nested.alias("responses"))


def group_advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """With advantage: the reward less its group's mean, over its standard deviation (0 where all are alike).

    Group statistics are aggregated first and joined back, so a hot group isn't gathered in one task as a window would.
    """
    stats = rows.groupBy(group).agg(F.avg(reward).alias("__mean"), F.stddev_pop(reward).alias("__sd"))
    joined = rows.join(stats, group)
    return joined.withColumn("advantage", F.when(F.col("__sd") > 0, (F.col(reward) - F.col("__mean")) / F.col("__sd")).otherwise(F.lit(0.0))).drop("__mean", "__sd")


def total_reward(correct: Column, length: Column, well_formed: Column, free_length: int, per_char: float, format_penalty: float) -> Column:
    """Correctness less a penalty for each character beyond ``free_length`` and one for a bad format."""
    over = F.greatest(length - free_length, F.lit(0))
    return correct.cast("double") - over * F.lit(per_char) - F.when(well_formed, F.lit(0.0)).otherwise(F.lit(format_penalty))


def boundary_groups(rows: DataFrame, group: str, verdict: str = "is_correct", low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Groups whose accuracy lies within the bounds, with it."""
    return correctness(rows, group, verdict).where(F.col("ratio").between(low, high)).select(group, "total", F.col("ratio").alias("accuracy"))


def best_of(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row from (status, n_responses, n_tokens, elapsed): both definitions of completed, and the rates.

    status is completed, failed or skipped; a scheduler's completed leaves the skipped out,
    an executor's counts them.
    """
    done = lambda s: F.count_if(F.col("status") == s)
    seconds, tokens = F.coalesce(F.sum("elapsed"), F.lit(0.0)), F.coalesce(F.sum("n_tokens"), F.lit(0))
    return outcomes.agg(
        F.count("*").alias("total_prompts"),
        done("completed").alias("completed_scheduler"),
        (done("completed") + done("skipped")).alias("completed_executor"),
        done("failed").alias("failed"),
        done("skipped").alias("skipped"),
        F.coalesce(F.sum("n_responses"), F.lit(0)).alias("total_responses"),
        tokens.alias("total_tokens"),
        F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0)).alias("tokens_per_second"),
        F.when(seconds > 0, done("completed") * 60 / seconds).otherwise(F.lit(0.0)).alias("prompts_per_minute"),
    )
