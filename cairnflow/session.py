"""Session defaults; a cluster's own settings come first."""

from __future__ import annotations

import logging
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "cairnflow", **conf: str) -> SparkSession:
    """A session with DEFAULTS under ``conf``; double underscores in names stand for dots."""
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def setup_logging(level: int = logging.INFO, file: str | None = None) -> None:
    """Log to the console, and to a file if one is named."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, a temporary one on a local master (tests), and an error on a cluster."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cairnflow-")
    sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; its partitions are fixed from then on.

    The files outlive executors, and Spark's cleaner drops them once no plan uses them
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it takes it)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def removed(spark: SparkSession, path: str) -> bool:
    """Remove a folder that the library made; whether there was one."""
    fs, at = file_system(spark, path)
    return fs.delete(at, True)
