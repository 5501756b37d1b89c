"""A table that shows whole commits alone: tasks write apart, and the driver publishes what belongs.

    spark.dataSource.register(committed.Committed)
    df.write.format("cairn_committed").mode("append").option("commit_id", "batch-7").save(path)
    spark.read.format("cairn_committed").load(path)

Every task attempt writes a Parquet file of its own name under ``data``.  When all tasks are
done, the driver writes one manifest that lists the files of those attempts that Spark counts,
first beside and then, by a rename, in its place.  A reader takes only files that a manifest
lists; so failed jobs, retried and speculative tasks, and drivers that die leave no row.  A
commit whose id is there already is dropped, so a batch that is played again counts once.

Paths are those of PyArrow's file systems (local and mounted folders, hdfs, s3, gs), which
the driver and the executors share.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):  # Hadoop writes file:/x, and file:///x
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def manifests(path: str) -> list[dict]:
    """The table's commits in order, from the last that replaced all before."""
    store, home = opened(path)
    found = store.get_file_info(fs.FileSelector(f"{home}/manifests", allow_not_found=True))
    out: list[dict] = []
    for info in sorted((i for i in found if i.base_name.endswith(".json")), key=lambda i: i.base_name):
        with store.open_input_stream(info.path) as f:
            commit = json.loads(f.read())
        out = [commit] if commit["replaces"] else [*out, commit]
    return out


@dataclass
class Written(WriterCommitMessage):
    """A task's file, or none where it had no rows."""

    file: str | None
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, replaces: bool, commit_id: str):
        self.path, self.schema, self.replaces, self.commit_id = path, schema, replaces, commit_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file of this attempt's own; one that fails takes its part away."""
        store, home = opened(self.path)
        name, rows, out = f"{uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(f"{home}/data", recursive=True)
                    out = pq.ParquetWriter(f"{home}/data/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
                rows += batch.num_rows
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{home}/data/{name}")
            raise
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Publish the files of the attempts that count, unless the commit's id is there."""
        store, home = opened(self.path)
        files = [m.file for m in messages if m is not None and m.file]
        if any(c["commit_id"] == self.commit_id for c in manifests(self.path)):
            self.abort(messages)
            return
        store.create_dir(f"{home}/manifests", recursive=True)
        name = f"{time.time_ns():020d}-{uuid4().hex}"
        told = {"commit_id": self.commit_id, "replaces": self.replaces, "schema": self.schema.json(), "rows": sum(m.rows for m in messages if m is not None), "files": files}
        with store.open_output_stream(f"{home}/manifests/{name}.tmp") as f:
            f.write(json.dumps(told).encode())
        store.move(f"{home}/manifests/{name}.tmp", f"{home}/manifests/{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Take away what finished tasks wrote; files of attempts that died stay unlisted until :func:`tidied`."""
        store, home = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{home}/data/{m.file}")


@dataclass
class File(InputPartition):
    name: str = ""
    value: None = field(default=None)


class Reader(DataSourceReader):
    """A file that is listed is a partition, which an executor reads batch by batch."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[File]:
        return [File(name=f) for c in manifests(self.path) for f in c["files"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, File):  # no files: Spark asks once for nothing
            return
        store, home = opened(self.path)
        wanted = to_arrow_schema(self.schema)
        with store.open_input_file(f"{home}/data/{partition.name}") as f:
            file = pq.ParquetFile(f)
            there = set(file.schema_arrow.names)
            for batch in file.iter_batches(columns=[c for c in wanted.names if c in there], use_threads=False):
                yield pa.RecordBatch.from_arrays([batch.column(c.name).cast(c.type) if c.name in there else pa.nulls(batch.num_rows, c.type) for c in wanted], schema=wanted)


class Committed(DataSource):
    """Format ``cairn_committed``; options path and commit_id (for a batch that may be played again)."""

    @classmethod
    def name(cls) -> str:
        return "cairn_committed"

    def schema(self) -> StructType:
        """The latest commit's."""
        commits = manifests(self.options["path"])
        if not commits:
            raise FileNotFoundError(f"no commits in {self.options['path']}")
        return StructType.fromJson(json.loads(commits[-1]["schema"]))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite, self.options.get("commit_id", uuid4().hex))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)


def append(rows: DataFrame, path: str, commit_id: str | None = None) -> None:
    """One commit; dropped if one of this id is there."""
    rows.sparkSession.dataSource.register(Committed)
    out = rows.write.format("cairn_committed").mode("append")
    (out if commit_id is None else out.option("commit_id", commit_id)).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows."""
    spark.dataSource.register(Committed)
    return spark.read.format("cairn_committed").load(path)


def tidied(path: str, older_than: float = 86_400.0) -> int:
    """Take away files that no manifest lists and that are older than so many seconds; how many."""
    store, home = opened(path)
    listed = {f for c in manifests(path) for f in c["files"]}
    found = store.get_file_info(fs.FileSelector(f"{home}/data", allow_not_found=True))
    gone = [i for i in found if i.base_name not in listed and time.time() - i.mtime_ns / 1e9 >= older_than]
    for i in gone:
        store.delete_file(i.path)
    return len(gone)
