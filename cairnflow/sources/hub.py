"""Datasets of a public hub, read by the executors: a partition for each row group of the split's Parquet files.

The driver reads the files' footers alone, which gives every row group the place of its first
row; a hub keeps a Parquet form of each dataset for such readers.  A folder that any of
PyArrow's file systems reaches stands for a dataset as well.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.json import parsed
from .committed import opened

#: Where the hub keeps a dataset's Parquet form.
PARQUET_FORM = "datasets/{path}@refs%2Fconvert%2Fparquet"
#: Rows that are turned into JSON at a time.
BATCH = 1000


def located(path: str, token: str | None) -> tuple[fs.FileSystem, str]:
    """(file system, folder) of a dataset: a folder's own, or the hub's."""
    if path.startswith("/") or ":" in path:
        return opened(path)
    try:
        from huggingface_hub import HfFileSystem
    except ImportError as e:
        raise ImportError("the library 'huggingface_hub' is needed to read datasets of the hub") from e
    return fs.PyFileSystem(fs.FSSpecHandler(HfFileSystem(token=token))), PARQUET_FORM.format(path=path)


@dataclass
class RowGroup(InputPartition):
    file: str = ""
    group: int = 0
    first: int = 0
    value: None = field(default=None)


class HubReader(DataSourceReader):
    def __init__(self, path: str, name: str, split: str, token: str | None):
        self.path, self.name, self.split, self.token = path, name, split, token

    def partitions(self) -> list[RowGroup]:
        """Row groups in the order of the files' names.  Files of the split: a folder of its name, or names that begin with it."""
        store, home = located(self.path, self.token)
        top = f"{home}/{self.name}" if self.name else home
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        mine = re.compile(rf"(^|.*/)(partial-)?{re.escape(self.split)}(/.*|[-_.\d][^/]*)?\.parquet$")
        files = sorted(i.path for i in found if i.is_file and mine.match(i.path[len(top) + 1 :]))
        if not files:
            raise FileNotFoundError(f"no Parquet files of the split {self.split!r} in {top}")
        out, first = [], 0
        for file in files:
            with store.open_input_file(file) as f:
                told = pq.ParquetFile(f).metadata
            for group in range(told.num_row_groups):
                out.append(RowGroup(file=file, group=group, first=first))
                first += told.row_group(group).num_rows
        return out

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, RowGroup):
            return
        store, _ = located(self.path, self.token)
        at = partition.first
        with store.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=BATCH, row_groups=[partition.group], use_threads=False):
                rows = [json.dumps(r, default=str) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.string())], ["ordinal", "json"])
                at += len(rows)


class Hub(DataSource):
    """Format ``cairn_hub``: (ordinal, json); options path, name, split and token."""

    @classmethod
    def name(cls) -> str:
        return "cairn_hub"

    def schema(self) -> str:
        return "ordinal long, json string"

    def reader(self, schema: StructType) -> HubReader:
        o = self.options
        return HubReader(o["path"], o.get("name", ""), o.get("split", "train"), o.get("token"))


def scan_hub(spark: SparkSession, path: str, name: str | None = None, split: str = "train", token: str | None = None) -> DataFrame:
    """(ordinal, raw) of a dataset's split, read by the executors; no row goes through the driver.

    ``path`` is a dataset of the hub, which takes the library huggingface_hub and a network, or a
    folder of Parquet files; ImportError without the library, FileNotFoundError without files.
    """
    located(path, token)
    spark.dataSource.register(Hub)
    given = {k: v for k, v in (("path", path), ("name", name), ("split", split), ("token", token)) if v}
    return spark.read.format("cairn_hub").options(**given).load().select("ordinal", parsed(F.col("json")).alias("raw"))
