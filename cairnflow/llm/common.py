"""Shared helpers: checkpoints in the shared folder, lookups, Arrow batches, key runs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, checkpointed  # noqa: F401  the operators take them from here


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys of a lookup that are sent to every executor, at most.
MOST_HOT = 10_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, total: int, own_key: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts`` for their ``own_key`` (``key`` by default), the long ``key`` there; null where it has none.

    ``facts`` has a column n, how many of the ``total`` rows have the key, which isn't kept.  Keys
    of more than a MOST_HOTth of the rows, so no more than MOST_HOT, are broadcast, and their
    rows are spread over all tasks; only the others are dealt by key.
    """
    own = own_key or key
    values = [c for c in facts.columns if c not in (key, "n")]
    known = facts.select(F.col(key).alias("__key"), F.struct(*values).alias("__fact"), "n")
    hot = known.where(F.col("n") > max(100, total // MOST_HOT)).select(F.col("__key").alias("__hot"), F.col("__fact").alias("__known"))
    first = rows.join(F.broadcast(hot), F.col(own) == F.col("__hot"), "left")
    # a hash may fall on a key, but a broadcast fact comes first
    dealt = first.withColumn("__dealt", F.when(F.col("__hot").isNull(), F.col(own)).otherwise(F.xxhash64(*rows.columns)))
    joined = dealt.join(known.drop("n"), F.col("__dealt") == F.col("__key"), "left").withColumn("__fact", F.coalesce("__known", "__fact"))
    return joined.select(*rows.columns, *(F.col("__fact")[c].alias(c) for c in values))


def release_memory() -> None:
    """Give freed memory back to the system: a worker outlives its tasks, and an executor's workers share its memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_slices(
    batches: Iterable[pa.RecordBatch],
    sized_by: str,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    most_bytes: int = 4 << 20,
) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to slices of about ``most_bytes`` of the string or binary column ``sized_by``."""
    try:
        yield from slices_of(batches, sized_by, work, most_bytes)
    finally:
        release_memory()


def slices_of(batches: Iterable[pa.RecordBatch], sized_by: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], most_bytes: int) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(sized_by)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            out = work(batch.slice(a, b - a))
            if out is not None and out.num_rows:
                yield out


def strings(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key runs from batches sorted by ``keys``; a run never spans two tables.

    Holds one batch and the run that is open at its end, so memory follows the largest run.
    """
    import numpy as np

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and any(held[-1].column(k)[-1] != table.column(k)[0] for k in keys):
            yield pa.concat_tables(held)
            held = []
        changes = np.zeros(table.num_rows - 1, dtype=bool)
        for k in keys:
            v = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            changes |= v[1:] != v[:-1]
        at = np.flatnonzero(changes)
        if len(at):
            yield pa.concat_tables([*held, table.slice(0, int(at[-1]) + 1)])
            held = [table.slice(int(at[-1]) + 1)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)
