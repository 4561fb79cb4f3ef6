"""Token counts by a two-tier lookup of pre-token lengths on the map side.

A SentencePiece model whose pieces hold the space mark only in front never merges over
the gap before a run of spaces, so a text's count is the sum over its pre-tokens: a run
of spaces and what follows up to the next one.  Tier one is a broadcast table of the
``table_size`` most frequent pre-tokens of all whole texts: a first pass counts them on the
map side, in tables of bounded size, and each task gives out its ``partial_size`` most
frequent ones, whose counts are added up (this picks what is cached, never what is
counted).  Tier two is a bounded cache in each worker, filled by encoding misses.  Texts
and their pre-tokens are not shuffled, only these summaries are.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship

_RUNS = re.compile(r" +[^ ]*")
_MARK = "▁"
#: Worker cache: entries, and the longest pre-token kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64

_models: dict[str, object] = {}


def load_model(path: str):
    """The SentencePiece model at ``path``, loaded once per process."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece spans words; pre-tokens can't be counted alone")
        _models[path] = model
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space."""
    if not text:
        return []
    if _MARK in text:
        text = text.replace(_MARK, " ")
    if "  " in text or text[0] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")


class Lengths(dict):
    """Frequent lengths; a miss goes to the worker's cache and then to the model."""

    def __init__(self, frequent: dict[str, int], encode) -> None:
        super().__init__(frequent)
        self[""] = 1  # a lone space mark
        self.encode, self.cache = encode, {}

    def __missing__(self, token: str) -> int:
        n = self.cache.get(token)
        if n is None:
            n = len(self.encode(token))
            if len(token) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[token] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


_lengths: dict[str, Lengths] = {}


def frequent_lengths(docs: DataFrame, model_path: str, text_col: str, table_size: int, partial_size: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all texts; of equal counts the least pre-token comes first."""
    room = 8 * max(table_size, partial_size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py()))
                if len(seen) > room:
                    seen = Counter(dict(seen.most_common(room // 2)))
        best = heapq.nsmallest(partial_size, ((-n, t) for t, n in seen.items() if len(t) <= CACHE_CHARS))
        yield pa.RecordBatch.from_arrays([pa.array([t for _, t in best], pa.string()), pa.array([-n for n, _ in best], pa.int64())], ["token", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(partial, "token string, n long")
    rows = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(table_size).collect()
    tokens = [r.token for r in rows]
    return dict(zip(tokens, map(len, load_model(model_path).encode(tokens, num_threads=1)))) if tokens else {}


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    table_size: int = 1 << 16, partial_size: int = 1 << 13,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, one row per input row.

    Counts equal the model's own ``encode`` without begin or end tokens.  A null text is
    empty and has no tokens.  Repeated ids and other columns do no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, model_path, text_col, table_size, partial_size))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{model_path}#{table.id if hasattr(table, 'id') else id(table)}"
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = Lengths(table.value, load_model(model_path).encode)
        lengths = _lengths[key]
        for batch in batches:
            texts = batch.column(1)
            n = [lengths.count(t.as_py()) for t in texts]
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
