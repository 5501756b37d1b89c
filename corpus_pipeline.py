"""A corpus from raw documents to packed training sequences.

STAGES lists the stages in order; each takes (spark, docs, sf_dir), works on all rows that
its predecessor kept, and all but the last return the columns of documents.  ``run`` applies
them to the documents table, each stage written to the shared checkpoint folder as Parquet
and read again, so a lost executor never sets the pipeline back by more than a stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import common, langid, packing, queries, secrets, simhash, suffix
from cairnflow.session import removed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or a narrow margin between languages."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates."""
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that an earlier document, or the same one earlier, holds."""
    return recounted(suffix.cut(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by the name of their kind."""
    return recounted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of all documents into sequences."""
    return packing.pack(docs, queries.vocabulary())


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: SQL can't express the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows.

    A stage's table is removed once the next one's is written, so one copy of the corpus stays,
    that which the result is read from.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{folder}/{k}-{name}")
            if k:
                removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            out = spark.read.parquet(f"{folder}/{k}-{name}")
        docs = out
    return docs
