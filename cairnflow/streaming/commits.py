"""Long, costly work in committed steps: a stream over rows that wait, appended batch by batch.

The rows that wait are written down first and read as a stream, so every micro-batch is a
fixed set of files.  What a batch gives is appended under its number before the stream's own
log says that the batch is done.  A driver that dies loses at most the batch in hand; one that
dies between the two asks again for nothing, as keys that a batch's folder holds already are
left out when it is played again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..session import exists, removed

log = logging.getLogger(__name__)


def keys_in(spark: SparkSession, folder: str, key: str, kind: str) -> DataFrame | None:
    """Distinct values of ``key`` in a Parquet folder; None where there is no folder."""
    try:
        return spark.read.schema(f"`{key}` {kind}").parquet(folder).distinct()
    except AnalysisException:
        return None


def in_batches(
    rows: DataFrame,
    key: str,
    work: Callable[[DataFrame], DataFrame],
    out: str,
    state: str,
    every: int,
    made_key: str | None = None,
    after: Callable[[int], None] | None = None,
) -> None:
    """Append ``work`` of ``rows`` to Parquet under ``out``, a folder ``batch=N`` for some ``every`` rows, each committed before the next begins.

    ``work`` turns a batch of rows into what is appended; its column ``made_key`` (``key`` by default) says
    which rows an output row is of.  ``state`` holds the rows that wait and the stream's log; a second call with
    the same folders goes on where the first stopped, whatever its ``rows``, and once all is
    done the folder is removed.  ``after`` is called with each batch's number once its rows
    are there.  Rows with a null key are worked on, and again if their batch is.  A row's
    output must come from that row alone.
    """
    spark, made = rows.sparkSession, made_key or key
    waiting = f"{state}/waiting"
    if not exists(spark, f"{waiting}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(waiting)
    held = spark.read.schema(rows.schema).parquet(waiting)
    n, files = held.count(), len(held.inputFiles())
    if not n:
        removed(spark, state)
        return
    kind = rows.schema[key].dataType.simpleString()

    def step(batch: DataFrame, number: int) -> None:
        folder = f"{out}/batch={number}"
        there = keys_in(batch.sparkSession, folder, made, kind)
        if there is not None:  # played again
            batch = batch.join(there.withColumnRenamed(made, key), key, "left_anti").select(*rows.columns)
        work(batch).write.mode("append").parquet(folder)
        if after is not None:
            after(number)

    # a file is read whole, so a batch is as many files as come to ``every`` rows
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, every * files // n)).parquet(waiting)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    removed(spark, state)
