"""Run metrics that come with a job: counts and rates, observed while rows pass."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class RunMetrics:
    """Counts prompts, errors and tokens of responses as they pass to a sink; no second pass over them.

        metrics = RunMetrics(total=1000)
        metrics.watch(responses).write.parquet(path)
        metrics.report()
    """

    def __init__(self, total: int = 0):
        self.total, self.started = total, time.time()
        self.seen = Observation()

    def watch(self, responses: DataFrame) -> DataFrame:
        return responses.observe(
            self.seen,
            F.count("*").alias("responses"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
            F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"),
        )

    def report(self) -> dict[str, float]:
        """Waits for the job that the watched rows passed in."""
        got = self.seen.get
        seconds = time.time() - self.started
        done = got["responses"] - got["errors"]
        return got | {
            "elapsed_seconds": seconds,
            "tokens_per_second": got["tokens"] / seconds if seconds > 0 else 0.0,
            "prompts_per_minute": done * 60 / seconds if seconds > 0 else 0.0,
            "progress_percent": done * 100 / self.total if self.total else 0.0,
        }
