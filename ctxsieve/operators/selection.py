"""Budgeted selection of chunks: rank, guards, floor, rebuild, statistics.

A block stays one row: its chunks, their scores and what is kept are arrays.  Only the
terms of its chunks become rows, to be counted, in the partitioning that the blocks have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEPARATOR, SelectionConfig
from ..functions.text import approx_tokens, marker_text, matches_any, strip, tokens
from .chunking import sentences, split_chunks
from .placing import placed
from .scoring import block_scores, check_embedder, embedded


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once a row, also if a lambda function refers to them.

    A projection would be merged into the expression that uses it, and run for each element.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def chunk_blocks(blocks: DataFrame, cfg: SelectionConfig) -> DataFrame:
    """``blocks`` with ``chunks`` and ``n``, null in blocks under a gate or with a blank question.

    Nulls instead of a filter: a filter on the number of chunks would be pushed below the
    splitting and split every text several times.
    """
    asked = (F.char_length("text") >= cfg.min_message_chars) & (strip(F.coalesce("query", F.lit(""))) != "")
    staged = blocks.withColumn("_text", F.when(asked, F.col("text")))
    split = split_chunks(staged, "_text", cfg.min_chunks, "_chunks") if cfg.shapes else staged.withColumn("_chunks", sentences(F.col("_text")))
    enough = F.when(F.size("_chunks") >= cfg.min_chunks, F.col("_chunks"))
    return split.withColumn("chunks", enough).drop("_chunks", "_text").withColumn("n", F.when(F.col("chunks").isNotNull(), F.size("chunks")))


def with_rare(chunked: DataFrame) -> DataFrame:
    """``chunked`` with ``low``, its chunks in lower case, and ``rare``: query tokens of four characters or more that stand in one or two chunks, as substrings."""
    lowered = hold(chunked, low=F.transform("chunks", F.lower))
    asked = F.array_distinct(F.filter(tokens(F.col("query")), lambda t: F.char_length(t) >= 4))
    seldom = lambda t: F.array_contains(F.array(F.lit(1), F.lit(2)), F.size(F.filter("low", lambda c: F.contains(c, t))))
    return hold(lowered, rare=F.when(F.col("low").isNotNull(), F.filter(asked, seldom)))


def score_blocks(blocks: DataFrame, cfg: SelectionConfig, embed: Callable | None = None) -> DataFrame:
    """``blocks (block_id, text, query, ...)`` with ``chunks, n, scores, pinned``, arrays with a place for each chunk.

    ``blocks`` should be partitioned by block; all but an embedder's call keeps that.
    """
    chunked = chunk_blocks(blocks, cfg)
    if embed:
        scored = chunked.withColumn("scores", embedded(F.col("chunks"), F.col("query"), embed, blocks.sparkSession))
        scored = scored.withColumn("chunks", F.when(F.col("scores").isNotNull(), F.col("chunks"))).withColumn("n", F.when(F.col("scores").isNotNull(), F.col("n")))
    else:
        # a slice, as exploding the column itself would add a filter that is pushed below the splitting
        terms = chunked.select("block_id", "query", F.slice("chunks", F.lit(1), F.col("n")).alias("chunks"))
        scored = chunked.join(block_scores(terms), "block_id", "left")
    marked = with_rare(scored)
    guarded = lambda c, low: matches_any(c, cfg.pin_patterns) | F.exists("rare", lambda e: F.contains(low, e))
    return marked.withColumn("pinned", F.zip_with("chunks", "low", guarded)).drop("low", "rare")


def budget(n: Column, keep: Column) -> Column:
    """Chunks to keep of n: rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.least(n, F.bround(n * keep).cast("int")))


def rank_blocks(scored: DataFrame) -> DataFrame:
    """``scored`` with ``ranks``, by falling score and then place, and ``top``."""
    ids = F.size("scores") != F.col("n")
    checked = F.when(ids, F.raise_error(F.lit("block ids repeat"))).otherwise(F.col("scores"))
    order = scored.withColumn("order", F.array_sort(F.transform(checked, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))))
    places = F.array_sort(F.transform("order", lambda o, k: F.struct(o["i"].alias("i"), (k + 1).alias("k"))))
    return order.withColumn("ranks", F.transform(places, lambda p: p["k"])).withColumn("top", F.array_max("scores")).drop("order")


def decide_blocks(ranked: DataFrame, cfg: SelectionConfig, keep: Column) -> DataFrame:
    """``ranked`` with ``kept``, the places of the chunks that stay, in order; ``keep`` may be a column of it."""
    floor = F.when(F.col("top") > 0, F.col("top") * cfg.relative_floor).otherwise(0.0)
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))
    staged = hold(ranked, _floor=floor, _budget=budget(F.col("n"), keep), _each=F.arrays_zip(every.alias("i"), F.col("scores"), F.col("ranks"), F.col("pinned")))

    def stays(c: Column) -> Column:
        edge = (c["i"] == 0) | (c["i"] == F.col("n") - 1)
        held = c["pinned"] | edge if cfg.keep_lead_tail else c["pinned"]
        return ((c["ranks"] <= F.col("_budget")) | held) & ((c["scores"] >= F.col("_floor")) | c["pinned"] | edge)

    return hold(staged, kept=F.transform(F.filter("_each", stays), lambda c: c["i"])).drop("_floor", "_budget", "_each")


def rebuild_blocks(decided: DataFrame, cfg: SelectionConfig) -> DataFrame:
    """``decided`` with ``dropped, runs, new_text``, and ``kept`` as a number; a run of dropped chunks is one marker."""
    ends, before = F.concat("kept", F.array("n")), F.concat(F.array(F.lit(-1)), "kept")
    gaps = hold(decided, _gaps=F.zip_with(ends, before, lambda k, b: F.struct(k.alias("k"), (k - b - 1).alias("gap"))))
    nothing = F.expr("cast(array() as array<string>)")

    def part(g: Column) -> Column:
        marker = F.when(g["gap"] > 0, F.array(marker_text(cfg.drop_marker, g["gap"]))).otherwise(nothing)
        return F.concat(marker, F.when(g["k"] < F.col("n"), F.array(F.get("chunks", g["k"]))).otherwise(nothing))

    built = gaps.withColumn("new_text", F.array_join(F.flatten(F.transform("_gaps", part)), SEPARATOR))
    built = built.withColumn("runs", F.size(F.filter("_gaps", lambda g: g["gap"] > 0)))
    kept = F.when(F.col("kept").isNotNull(), F.size("kept"))
    return built.withColumn("kept", kept).withColumn("dropped", F.col("n") - F.col("kept")).drop("_gaps")


def decide(scored: DataFrame, cfg: SelectionConfig, keep: Column) -> DataFrame:
    """``block_id, n, idx, chunk, kept``: a row for each chunk of scored blocks."""
    decided = decide_blocks(rank_blocks(scored), cfg, keep)
    rows = decided.select("block_id", "n", "kept", F.posexplode("chunks").alias("idx", "chunk"))
    return rows.withColumn("kept", F.array_contains("kept", F.col("idx")))


def select_blocks(blocks: DataFrame, keep: float | Column = 0.6, cfg: SelectionConfig | None = None, embed: Callable | None = None) -> DataFrame:
    """``blocks (block_id, text, query, ...)`` with ``n, kept, dropped, runs, changed, new_text``.

    ``block_id`` tells blocks apart; where blocks share one, the query fails.  Blocks under a
    gate, with a null or blank question, of which nothing is dropped, or whose embedder failed come
    back with their text and ``changed`` false; ``n`` is then null or equal to ``kept``.
    ``keep`` may be a column of ``blocks``.
    """
    cfg = cfg or SelectionConfig()
    if embed:
        check_embedder(embed)
    keep = F.lit(float(keep)) if isinstance(keep, (int, float)) else keep
    by_block = placed(blocks, "block_id") if embed is None else blocks
    built = rebuild_blocks(decide_blocks(rank_blocks(score_blocks(by_block, cfg, embed)), cfg, keep), cfg)
    changed = F.coalesce(F.col("dropped") > 0, F.lit(False))
    return built.withColumn("changed", changed).withColumn("new_text", F.when(changed, F.col("new_text")).otherwise(F.col("text"))).select(
        *blocks.columns, "n", "kept", "dropped", "runs", "changed", "new_text")


def selection_stats(selected: DataFrame) -> DataFrame:
    """One row: blocks changed, chunks and characters before and after, approximate tokens saved."""
    changed = selected.where("changed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return changed.agg(
        F.count("*").alias("blocks"), total(F.col("n")).alias("chunks_in"), total(F.col("kept")).alias("chunks_kept"),
        total(F.char_length("text")).alias("chars_in"), total(F.char_length("new_text")).alias("chars_out"),
        total(approx_tokens(F.col("text")) - approx_tokens(F.col("new_text"))).alias("tokens_saved"),
    )


def observed(selected: DataFrame, name: str = "selection"):
    """``selected`` and an ``Observation`` with its statistics, filled by the first action over it: no second pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    total = lambda c: F.coalesce(F.sum(F.when(F.col("changed"), c)), F.lit(0)).cast("long")
    return selected.observe(
        seen, total(F.lit(1)).alias("blocks"), total(F.col("n")).alias("chunks_in"), total(F.col("kept")).alias("chunks_kept"),
        total(F.char_length("text")).alias("chars_in"), total(F.char_length("new_text")).alias("chars_out")), seen


def make_selection_transform(embed: Callable | None = None, tier: Column | str = "mid", complexity: Column | float | None = None, cfg: SelectionConfig | None = None):
    """A name and a function for ``DataFrame.transform`` over blocks; ``tier`` and ``complexity`` may be columns."""
    from ..config import keep_column

    cfg = cfg or SelectionConfig()
    return "context_selection", lambda blocks: select_blocks(blocks, keep_column(cfg, tier, complexity), cfg, embed)
