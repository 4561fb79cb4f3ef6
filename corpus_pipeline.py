"""A training corpus from the documents table, stage by stage.

Each stage takes the documents that the one before kept and returns the same columns, the
last one their ids.  Null and empty texts pass through every stage but the classifier's
verdict; rows that repeat an id are judged alone, but of equal or nearly equal texts one row
stays, and texts without words all stay; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ctxsieve.llm.decontamination import drop_contaminated
from ctxsieve.llm.near_dedup import drop_near_duplicates
from ctxsieve.llm.pieces import encode_pieces
from ctxsieve.llm.pii import redact
from ctxsieve.llm.quality_classifier import drop_low_quality
from ctxsieve.llm.queries import table, tokenizer
from ctxsieve.llm.session import ensure_checkpoint_dir, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_crc32, round_trip`` of each document."""
    return encode_pieces(docs, tokenizer())


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", private),
    ("pieces", pieces),
]

#: SQL can't express the classifier, the links' components or the encoding.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again.

    A stage's folder is deleted when the next one is written; the last one's stays for the
    result to be read from.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
        release(spark)
    return docs
