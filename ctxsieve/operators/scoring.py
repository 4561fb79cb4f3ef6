"""Relevance of chunks to a question: block-local tf-idf, dense vectors, own embedders."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_token, tokens
from ..workers import ship

#: Scores are rounded so that the order of float sums can't flip a decision.
DIGITS = 12
#: Stands for a text without a token, so that each text keeps a row.
_NONE = ""


def term_weights(blocks: DataFrame, every_text: bool = False) -> DataFrame:
    """``block_id, n, idx, token, tf, df, w`` of the chunks of ``blocks (block_id, chunks, query)``.

    The query is one more text with ``idx = n``; document frequencies are within the block.
    All steps keep a partitioning of ``blocks`` by block.  With ``every_text`` each text also
    has a row of weight 0 under the empty token.
    """
    texts = blocks.select("block_id", F.size("chunks").alias("n"), F.posexplode(F.concat("chunks", F.array("query"))).alias("idx", "chunk"))
    words = texts.select("block_id", "n", "idx", tokens(F.col("chunk")).alias("words"))
    held = F.array_append("words", F.lit(_NONE)) if every_text else F.slice("words", F.lit(1), F.size("words"))
    words = words.select("block_id", "n", "idx", F.size("words").alias("length"), F.explode(held).alias("token"))
    counted = words.groupBy("block_id", "n", "idx", "length", "token").agg(F.count("*").alias("c"))
    df = F.count("*").over(Window.partitionBy("block_id", "token"))
    tf = F.when(F.col("token") != _NONE, F.col("c") / F.col("length")).otherwise(0.0)
    return counted.withColumn("tf", tf).withColumn("df", df).withColumn("w", F.col("tf") * F.ln((F.col("n") + 2) / F.col("df"))).select(
        "block_id", "n", "idx", "token", "tf", "df", "w")


def block_scores(blocks: DataFrame) -> DataFrame:
    """``block_id, scores`` of chunked ``blocks``: an array with the tf-idf cosine of each chunk."""
    asked = F.max(F.when(F.col("idx") == F.col("n"), F.col("w"))).over(Window.partitionBy("block_id", "token"))
    sums = term_weights(blocks, every_text=True).withColumn("q", asked).groupBy("block_id", "n", "idx").agg(
        F.sum(F.col("w") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("norm"))
    rows = sums.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("idx", "dot", "norm"))).alias("rows"))
    asked_norm = F.element_at("rows", -1)["norm"]
    score = lambda r: F.when((r["norm"] > 0) & (asked_norm > 0), F.round(r["dot"] / (F.sqrt(r["norm"]) * F.sqrt(asked_norm)), DIGITS)).otherwise(0.0)
    return rows.select("block_id", F.transform(F.slice("rows", F.lit(1), F.size("rows") - 1), score).alias("scores"))


def lexical_scores(blocks: DataFrame) -> DataFrame:
    """``block_id, idx, score`` of the chunks of ``blocks`` that have a token; others score 0."""
    scored = blocks.join(block_scores(blocks), "block_id")
    rows = scored.select("block_id", F.posexplode(F.arrays_zip("chunks", "scores")).alias("idx", "c"))
    return rows.where(has_token(F.col("c.chunks"))).select("block_id", "idx", F.col("c.scores").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(norms > 0, dot(a, b) / norms).otherwise(0.0), DIGITS)


def vector_scores(vectors: Column, query: Column) -> Column:
    """Scores of chunk vectors that are already there, as an array column of arrays."""
    return F.transform(vectors, lambda v: cosine(v, query))


def check_embedder(embed: Callable) -> None:
    """Reject what could never work, before any plan is made; only its failures on data are passed over."""
    if not callable(embed):
        raise TypeError("an embedder is a function from texts to vectors")
    if inspect.iscoroutinefunction(embed) or inspect.iscoroutinefunction(getattr(embed, "__call__", None)):
        raise TypeError("an embedder must return vectors, not a coroutine")


def _similarities(vectors: list) -> list[float]:
    """Cosine of each vector but the last with the last: of dicts over shared keys, else dense."""
    import numpy as np

    if isinstance(vectors[-1], dict):
        norm = lambda v: sum(x * x for x in v.values()) ** 0.5
        asked = vectors[-1]
        out = [(sum(v[k] * asked[k] for k in sorted(v.keys() & asked.keys(), key=repr)), norm(v) * norm(asked)) for v in vectors[:-1]]
        return [round(dot / both, DIGITS) if both else 0.0 for dot, both in out]
    dense = np.asarray(vectors, float)
    norms, dots = np.linalg.norm(dense, axis=1) * np.linalg.norm(dense[-1]), dense @ dense[-1]
    return [round(float(dots[i] / norms[i]), DIGITS) if norms[i] else 0.0 for i in range(len(dense) - 1)]


def embedded(chunks: Column, query: Column, embed: Callable[[list[str]], list], spark) -> Column:
    """Scores by an embedder of the caller, called once per block with the chunks and then the query.

    It returns a vector, dense or a dict, for each text.  Where it fails or returns another
    number, the block's scores are null, which leaves the block as it is, and a line is logged.
    """
    check_embedder(embed)
    ship(spark)

    @F.pandas_udf("array<double>")
    def scored(chunks: pd.Series, query: pd.Series) -> pd.Series:
        out = []
        for parts, asked in zip(chunks, query):
            scores = None
            if parts is not None:
                try:
                    vectors = list(embed([*parts, asked]))
                    if len(vectors) != len(parts) + 1:
                        raise ValueError(f"{len(vectors)} vectors for {len(parts) + 1} texts")
                    scores = _similarities(vectors)
                except Exception:
                    logging.getLogger("ctxsieve").warning("a block is left as it is, as its embedder failed", exc_info=True)
            out.append(scores)
        return pd.Series(out, dtype=object)

    return scored(chunks, query)
