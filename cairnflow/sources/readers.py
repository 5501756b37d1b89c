"""Scans of task datasets and prompt files as (ordinal, raw VARIANT) rows, and of finished ids."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import parsed
from ..functions.text import strip
from ..session import checkpointed
from . import json_lists

log = logging.getLogger(__name__)


def indexed(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """With the place of each row, from 0, in the order of partitions and of rows in them.

    Partitions are counted in one job and numbered in another, so they must be the same in
    both: a scan's and a checkpoint's are, those behind a shuffle aren't
    (:func:`..operators.records.with_ordinal` makes them so).  What comes before each
    partition is a table of one small row for each, joined by its number.
    """
    held = rows.withColumn("__mid", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__mid", 33))
    counts = held.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    # a row of two numbers for each partition: 16 MB for a million partitions
    numbered = held.join(F.broadcast(starts), "__part")
    return numbered.select(*rows.columns, (F.col("__start") + F.col("__mid").bitwiseAND((1 << 33) - 1)).alias(name))


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    try:
        return spark.read.text(path, wholetext=whole)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, raw) of a file, or a folder of files, of one JSON list each, read in byte ranges; a missing file or another root raises, and so does broken JSON, at the latest when it is read."""
    read_text(spark, path)
    return json_lists.scan(spark, path)


def parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, raw, file, block) of all lines, stripped; raw is null where a line isn't JSON."""
    rows = read_text(spark, path).select(strip(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.select("value", parsed(F.col("value")).alias("raw"), "file", "block")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw): lines that aren't blank, with their place among all lines; raw is null where a line isn't JSON.

    Lines count on through the files of a folder in the order of their names.
    """
    return in_files(parsed_lines(spark, path), "line").where("value <> ''").select("line", "raw")


def in_files(rows: DataFrame, name: str) -> DataFrame:
    """With the place of each row, from 0, by file, block of the file, and place in the block, for a scan with columns file and block.

    Splits aren't read in the order of the files, so they are put in order by a table of one
    row for each, made by a first pass that counts.  It is broadcast at any size, as the driver
    holds more of each split itself.
    """
    held = rows.withColumn("__mid", F.monotonically_increasing_id())
    splits = held.groupBy("file", "block").agg(F.min("__mid").alias("__low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = checkpointed(splits.select(F.xxhash64("file", "block").alias("__split"), (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift")))
    return held.withColumn("__split", F.xxhash64("file", "block")).join(F.broadcast(starts), "__split").select(*rows.columns, (F.col("__mid") + F.col("__shift")).alias(name))


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, raw) of JSON lines; blank and broken lines are skipped and not counted in ordinals.

    Only good lines are numbered, so one pass counts them by split and another gives them out.
    """
    return in_files(parsed_lines(spark, path).where("raw is not null").select("raw", "file", "block"), "ordinal").select("ordinal", "raw")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Places of the lines that :func:`scan_jsonl` skips as broken."""
    return lines(spark, path).where("raw is null").select("line")


def truthy(raw: Column, key: str) -> Column:
    """The value of a key as text where Python would count it as true: not missing, null, empty, 0 or false."""
    value = F.try_variant_get(raw, f"$.{key}", "string")
    kind = F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    zero = (kind != "STRING") & value.isin("0", "0.0", "-0.0", "false")
    return F.when(value.isNotNull() & (value != "") & ~zero & (kind != "VOID"), value)


def begins_with(spark: SparkSession, path: str) -> str:
    """The first character of a file that isn't blank; empty without any.  Only as much is read as it takes."""
    shown = read_text(spark, path).select(F.substring(strip(F.col("value")), 1, 1).alias("c")).where("c <> ''").first()
    return shown[0] if shown else ""


def scan_prompts(spark: SparkSession, path: str, system_prompt: str = "") -> DataFrame:
    """(id, system_prompt, user_prompt, metadata) of a JSON list or a JSON lines file.

    The prompt is the first true one of problem, query and user_prompt, the id of id and
    task_id; the default id is prompt-N with the place in the list, or the line's place with
    blank lines counted.  An empty file has no prompts.  metadata holds the whole record.
    """
    rows = None
    if begins_with(spark, path) == "[":
        try:
            rows = json_lists.scan(spark, path, strict=False)
        except json_lists.NotAList:
            pass
        if rows is not None and not rows.where("raw is null").isEmpty():
            rows = None
    if rows is None:
        rows = lines(spark, path).where("raw is not null").withColumnRenamed("line", "ordinal")
    raw = F.col("raw")
    name = F.coalesce(truthy(raw, "id"), truthy(raw, "task_id"), F.concat(F.lit("prompt-"), F.col("ordinal").cast("string")))
    text = F.coalesce(truthy(raw, "problem"), truthy(raw, "query"), truthy(raw, "user_prompt"), F.lit(""))
    return rows.select(name.alias("id"), F.lit(system_prompt).alias("system_prompt"), text.alias("user_prompt"), raw.alias("metadata"))


def completed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct prompt ids in a folder of JSON lines of spectra; broken lines don't count, and neither does a missing folder."""
    try:
        found = spark.read.schema("prompt struct<id:string>").json(folder)
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], "id string")
    return found.select("prompt.id").where("id is not null").distinct()


def append_spectra(spectra: DataFrame, folder: str, best_effort: bool = False) -> bool:
    """Append as JSON lines; a failed job leaves no part of its output.  With ``best_effort`` a failure is logged and gives False."""
    try:
        spectra.write.mode("append").json(folder)
    except Exception:
        if not best_effort:
            raise
        log.exception("spectra weren't written to %s", folder)
        return False
    return True


class Checkpoint:
    """Finished ids by job, an append-only table in a folder; what a failed job wrote of it doesn't count."""

    def __init__(self, spark: SparkSession, folder: str, job_id: str):
        self.spark, self.folder, self.job_id = spark, folder, job_id

    def mark(self, ids: DataFrame) -> None:
        """Add a column ``id``'s values."""
        ids.select(F.col("id").cast("string").alias("id"), F.lit(self.job_id).alias("job_id")).distinct().write.mode("append").partitionBy("job_id").parquet(self.folder)

    def completed(self) -> DataFrame:
        """Distinct (id) of this job; none where the folder isn't there."""
        try:
            found = self.spark.read.schema("id string, job_id string").parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], "id string")
        return found.where(F.col("job_id") == self.job_id).select("id").distinct()


def write_summary(summary: DataFrame, folder: str) -> None:
    """One small JSON file, in the place of an earlier one."""
    summary.coalesce(1).write.mode("overwrite").json(folder)
