"""Responses as a stream: JSON lines that arrive as files, verified as they come, and correctness by persona and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verifiers

SCHEMA = "response_id string, prompt_id string, persona string, text string, token_count long, made timestamp"


def responses(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of SCHEMA; lines that can't be read have null ids and are dropped."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder).where("response_id is not null")


def verified(stream: DataFrame, truths: DataFrame, task_type: str = "math", late: str = "1 hour") -> DataFrame:
    """The stream joined to its truths (prompt_id, ground_truth_answer), a table, with parsed fields and verdict; a response counts once within ``late``."""
    once = stream.withWatermark("made", late).dropDuplicatesWithinWatermark(["response_id"])
    return verifiers.verify(once.join(truths, "prompt_id", "left"), task_type)


def correctness(judged: DataFrame, width: str = "10 minutes") -> DataFrame:
    """By window and persona: responses, correct ones, tokens; a window is final when the watermark has passed it."""
    right = F.count_if(F.col("is_correct").eqNullSafe(True))
    out = judged.groupBy(F.window("made", width).alias("w"), F.coalesce("persona", F.lit("unknown")).alias("persona")).agg(F.count("*").alias("total_count"), right.alias("correct_count"), F.sum("token_count").alias("tokens"))
    return out.select(F.col("w.start").alias("start"), "persona", "total_count", "correct_count", "tokens")
