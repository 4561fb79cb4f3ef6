"""Filter of retrieved document sets: which documents still matter to a question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEPARATOR, SelectionConfig
from ..functions.text import strip
from .placing import placed
from .selection import decide_blocks, hold, rank_blocks, score_blocks


def document_spans(docs: DataFrame) -> DataFrame:
    """``docs (set_id, pos, text)`` with ``start, stop`` in the set's joined block."""
    before = Window.partitionBy("set_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("text") + len(SEPARATOR)).over(before), F.lit(0))
    return docs.withColumn("start", start).withColumn("stop", F.col("start") + F.char_length("text"))


def joined_sets(docs: DataFrame, query: str = "query") -> DataFrame:
    """``block_id, text, query, rows``: each set's documents as one block, and all their columns in order."""
    # by a comparison, as other columns may be of types without an order
    ahead = lambda a, b: F.when((a["pos"] < b["pos"]) | a["pos"].eqNullSafe(b["pos"]) & (a["text"] < b["text"]), -1).when(a["pos"].eqNullSafe(b["pos"]) & a["text"].eqNullSafe(b["text"]), 0).otherwise(1)
    rows = docs.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", F.struct(*docs.columns).alias("row"))), ahead).alias("rows"), F.max(query).alias("query"))
    return rows.select(F.col("set_id").alias("block_id"), F.array_join(F.transform("rows", lambda r: F.coalesce(r["text"], F.lit(""))), SEPARATOR).alias("text"), "query", "rows")


def _starts(lengths: Column) -> Column:
    """Sums of the lengths and separators before each place."""
    return F.aggregate(
        lengths, F.expr("named_struct('next', 0, 'starts', cast(array() as array<int>))"),
        lambda s, n: F.struct((s["next"] + n + len(SEPARATOR)).alias("next"), F.array_append(s["starts"], s["next"]).alias("starts")), lambda s: s["starts"])


def chunk_places(chunks: str = "chunks", text: str = "text") -> Column:
    """The 1-based place of each chunk, looked for after the one before."""
    return F.expr(
        f"aggregate({chunks}, named_struct('next', 1, 'starts', cast(array() as array<int>)), (s, c) -> "
        f"named_struct('next', locate(c, {text}, s.next) + char_length(c), 'starts', concat(s.starts, array(locate(c, {text}, s.next)))), s -> s.starts)")


def select_documents(docs: DataFrame, keep: float = 0.6, cfg: SelectionConfig | None = None, embed: Callable | None = None) -> DataFrame:
    """``docs (set_id, pos, text, query, ...)`` with ``kept``; a document stays if a kept chunk overlaps it.

    Sets of one document, with a blank question, or of which nothing is dropped stay whole,
    as do blank documents, and sets that would lose all.  A set is gathered once and stays
    one row until its documents are given back.
    """
    cfg = (cfg or SelectionConfig()).with_keep(keep)
    sets = joined_sets(placed(docs, "set_id"))
    asked = sets.withColumn("query", F.when(F.size("rows") >= 2, F.col("query")))
    decided = decide_blocks(rank_blocks(score_blocks(asked, cfg, embed)), cfg, F.lit(float(keep)))
    cut = F.coalesce(F.size("kept") < F.col("n"), F.lit(False))
    lengths = F.transform("rows", lambda r: F.coalesce(F.char_length(r["text"]), F.lit(0)))
    staged = hold(decided, cut=cut, places=F.when(cut, chunk_places()), starts=_starts(lengths))
    span = lambda i: F.struct((F.get("places", i) - 1).alias("start"), (F.get("places", i) - 1 + F.char_length(F.get("chunks", i))).alias("stop"))
    staged = hold(staged, spans=F.transform("kept", span))

    def stays(r: Column, i: Column) -> Column:
        start = F.get("starts", i)
        hit = F.exists("spans", lambda c: (start < c["stop"]) & (c["start"] < start + F.char_length(r["text"])))
        return F.coalesce(~F.col("cut") | hit | (strip(r["text"]) == ""), F.lit(True))

    staged = hold(staged, flags=F.transform("rows", stays))
    staged = hold(staged, any=F.exists("flags", lambda x: x))
    rows = staged.select(F.explode(F.transform("rows", lambda r, i: F.struct(r["row"].alias("row"), (F.get("flags", i) | ~F.col("any")).alias("kept")))).alias("x"))
    return rows.select(*(F.col("x.row").getField(c).alias(c) for c in docs.columns), F.col("x.kept").alias("kept"))


def compress_documents(docs: DataFrame, keep: float = 0.6, **options) -> DataFrame:
    """The documents that ``select_documents`` keeps, with all their columns; no rows give no rows."""
    return select_documents(docs, keep, **options).where("kept").drop("kept")


def postprocess_nodes(nodes: DataFrame, keep: float = 0.6, metadata_mode: str = "none", metadata_col: str = "metadata", **options) -> DataFrame:
    """Nodes ``(set_id, pos, text, metadata, query, ...)`` of retrieved sets that still matter, untouched.

    ``metadata_mode`` ``all`` judges a node by its metadata entries (a map, as ``key: value``
    lines) and its text, ``none`` by its text alone.  A set without a question stays whole.
    """
    if metadata_mode not in ("none", "all"):
        raise ValueError("metadata_mode is none or all")
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(metadata_col)), lambda e: F.concat_ws(": ", e["key"], e["value"].cast("string"))), "\n")
    judged = F.concat_ws("\n", F.nullif(lines, F.lit("")), F.col("text")) if metadata_mode == "all" else F.col("text")
    shown = nodes.select("set_id", "pos", judged.alias("text"), "query", F.struct(*nodes.columns).alias("_node"))
    return select_documents(shown, keep, **options).where("kept").select("_node.*")
