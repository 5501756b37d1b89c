"""The first row of each id on a stream, whatever order its rows come in, with corrections.

State is one number for each id: the smallest place seen so far.  A row that comes with a
smaller one is given out and takes its place, so what a stream has given out so far has, for
each id, the first of all rows that it has read as the one with the smallest place; that is
what :func:`current` shows, and what :func:`..operators.records.dedup_first` gives of the same
rows.  With a ``ttl`` an id is forgotten some time after its last correction, which bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.records import dedup_first

#: Spark's state store for such state; set before the session's first stateful stream.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class First(StatefulProcessor):
    """Gives a row out if its place is below all that its id had before."""

    def __init__(self, order: str, ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", StructType([StructField("place", LongType())]), self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        best: pd.DataFrame | None = None
        for part in rows:
            least = part.loc[[part[self.order].idxmin()]]
            if best is None or least[self.order].iloc[0] < best[self.order].iloc[0]:
                best = least
        if best is None:
            return
        mine = int(best[self.order].iloc[0])
        if not self.place.exists() or mine < self.place.get()[0]:
            self.place.update((mine,))
            yield best.reset_index(drop=True)

    def close(self) -> None: ...


def first_wins(stream: DataFrame, key: str = "id", order: str = "ordinal", ttl: float | None = None) -> DataFrame:
    """A streaming DataFrame of the rows that are, when they come, the first of their ``key`` by ``order``, a long that isn't null.

    Each later one of a key corrects those before.  Without ``ttl`` (seconds) nothing is
    forgotten; with one, Spark looks at its clock again and again, so such a stream is one that
    runs on, not one that ends with what is there (availableNow).  The session needs the
    settings of STORE.
    """
    processor = First(order, None if ttl is None else int(ttl * 1000))
    return stream.groupBy(key).transformWithStateInPandas(processor, stream.schema, "append", "none" if ttl is None else "processingTime")


def current(spark: SparkSession, path: str, key: str = "id", order: str = "ordinal") -> DataFrame:
    """The rows that hold of a table that such a stream was appended to."""
    return dedup_first(spark.read.parquet(path), key, order)
