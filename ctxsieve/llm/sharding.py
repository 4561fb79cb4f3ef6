"""Stable shards by jump consistent hashing.

A document's shard depends on its id and the number of shards only; there is no ring
or table to keep.  With one more shard, a 1/(n+1) share of the documents moves, all of
it into the new shard.  Assigning is a projection.  Numbering the documents of a shard
without gaps takes one shuffle of narrow rows: rows are dealt to small chunks, numbered
inside their chunk, and moved by the rows of the shard's earlier chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, ship


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into ``shards`` buckets."""
    key = keys.astype(np.uint64)
    shard, jumped = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key)) if shards > 0 else np.zeros(0, np.int64)
    while len(going):
        shard[going] = jumped[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        jumped[going] = ((shard[going] + 1) * (2.0**31 / ((key[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        going = going[jumped[going] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of ``jump`` for a long key that is not null."""

    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard_of(key)


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row in the column ``name``, which replaces one of that name; a null id hashes as 0."""
    ship(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    return docs.withColumn(name, jump_shard(key, shards))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet folders ``path/shard=N``."""
    assign_shards(docs, shards, id_col).write.partitionBy("shard").parquet(path)


def shard_manifest(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per input row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1, ``slot`` numbers a shard's
    rows from 0 without gaps, ``grown_shard`` is the shard with one more shard.  Rows that
    share an id share a shard and differ in slot; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("key"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    # written, as the numbers of a shard's rows are counted and given out by two branches
    rows = cut(rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), jump_shard(F.col("key"), shards).alias("shard"),
        jump_shard(F.col("key"), shards + 1).alias("grown_shard"), "row_id",
    ))
    chunks = max(32, -(-rows.count() // (chunk_rows * shards)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(chunks)))
    chunk = Window.partitionBy("shard", "chunk")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        rows.withColumn("at", F.row_number().over(chunk.orderBy("row_id")))
        .join(starts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("at") - 1).alias("slot"), "grown_shard")
    )
