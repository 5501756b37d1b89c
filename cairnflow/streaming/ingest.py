"""Ingestion as a stream: JSON lines that arrive as files, mapped, checked, first of each id, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import parsed
from ..functions.text import strip
from ..operators.records import mapper


def entries(spark: SparkSession, folder: str, dataset: str, late: str = "1 hour", files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of entries: rejects dropped, one row of an id within ``late``, which bounds the state."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    rows = text.select(strip(F.col("value")).alias("value")).where("value <> ''")
    raw = rows.select(F.xxhash64("value").alias("ordinal"), parsed(F.col("value")).alias("raw")).where("raw is not null")
    mapped = mapper(dataset)[0](raw.select("ordinal", "raw")).withColumn("seen", F.current_timestamp())
    return mapped.where("reject is null").drop("reject").withWatermark("seen", late).dropDuplicatesWithinWatermark(["id"])


def run(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append to a Parquet table; the checkpoint makes every file count once, also after a restart."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
