"""SQL functions of a session, and answers to a table of trim requests."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import select_blocks
from ..workers import ship
from .single import split_text, trim_one

#: Codes of a request that can't be answered: bad parameters, unknown method.
BAD_PARAMETERS, UNKNOWN_METHOD = -32602, -32601


def register(spark: SparkSession) -> None:
    """``approx_tokens(s)``, ``split_sentences(s)``, ``cosine(a, b)``, ``split_chunks(s, least)`` and ``trim_text(s, query, keep)``.

    The last two judge one text at a time in Python; ``trim_text`` gives a text back as it is
    where anything fails, and logs that.
    """
    ship(spark)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION approx_tokens(s STRING) RETURNS BIGINT RETURN CAST(floor(char_length(s) / 4) AS BIGINT)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION split_sentences(s STRING) RETURNS ARRAY<STRING> "
        r"RETURN filter(split(regexp_replace(s, '(?U)^\\s+|\\s+$', ''), '(?U)(?<=[.!?])\\s+'), x -> x <> '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / "
        "nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 0D)"
    )

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, int(m)) for t, m in zip(texts, least)], dtype=object)

    @F.pandas_udf("string")
    def trim(texts: pd.Series, queries: pd.Series, keeps: pd.Series) -> pd.Series:
        out = []
        for text, query, keep in zip(texts, queries, keeps):
            try:
                text = trim_one(text, query, float(keep))
            except Exception:
                logging.getLogger("ctxsieve").warning("a text is given back as it is", exc_info=True)
            out.append(text)
        return pd.Series(out, dtype=object)

    spark.udf.register("split_chunks", split)
    spark.udf.register("trim_text", trim)


def trim_texts(requests: DataFrame, keep: float = 0.6) -> DataFrame:
    """Answers to ``requests (id, text, query, keep)``: ``id, text`` or an ``error``; a row's keep overrides.

    A keep outside 0 to 1, or a missing text or query, gives error -32602; a ``method`` column
    with another name than ``trim`` gives -32601.  Each row is answered, whatever its id; equal
    requests are decided once.
    """
    ratio = F.coalesce(F.col("keep").cast("double"), F.lit(float(keep)))
    bad = F.col("text").isNull() | F.col("query").isNull() | ~ratio.between(0.0, 1.0)
    unknown = F.coalesce(F.col("method") != "trim", F.lit(True)) if "method" in requests.columns else F.lit(False)
    rows = requests.select("id", "text", "query", ratio.alias("keep"), F.when(unknown, F.lit(UNKNOWN_METHOD)).when(bad, F.lit(BAD_PARAMETERS)).alias("error"))
    rows = rows.withColumn("block_id", F.when(F.col("error").isNull(), F.md5(F.to_json(F.struct("text", "query", "keep")))))
    asked = rows.where("error is null").select("block_id", "text", "query", "keep").dropDuplicates(["block_id"])
    done = select_blocks(asked, F.col("keep")).select("block_id", "new_text")
    return rows.join(done, "block_id", "left").select("id", F.col("new_text").alias("text"), "error")
