"""Conversations: which messages to trim, the question they answer, rewriting, accounting."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SelectionConfig
from ..functions.text import approx_tokens, marker_total, strip
from ..workers import ship
from .selection import select_blocks


def route(messages: DataFrame, cfg: SelectionConfig | None = None) -> DataFrame:
    """``messages (conv_id, msg_idx, role, content)`` with ``query, last_user_idx, selectable``.

    The question is the latest user text that is not blank; the latest user message is
    never selectable, whatever it holds.
    """
    cfg = cfg or SelectionConfig()
    conv = Window.partitionBy("conv_id")
    user = F.col("role") == "user"
    asked = user & (strip(F.coalesce("content", F.lit(""))) != "")
    staged = messages.withColumn("last_user_idx", F.max(F.when(user, F.col("msg_idx"))).over(conv)).withColumn(
        "query", F.max_by(F.when(asked, F.col("content")), F.when(asked, F.col("msg_idx"))).over(conv))
    free = F.coalesce(F.col("msg_idx") != F.col("last_user_idx"), F.lit(True))
    fits = F.col("role").isin(*cfg.selectable_roles) & (F.char_length("content") >= cfg.min_message_chars)
    return staged.withColumn("selectable", F.coalesce(fits & free & F.col("query").isNotNull(), F.lit(False)))


def trim_messages(messages: DataFrame, keep: float = 0.6, cfg: SelectionConfig | None = None, embed: Callable | None = None) -> DataFrame:
    """``messages`` with ``new_content, changed``; equal blocks of a conversation share one decision."""
    cfg = (cfg or SelectionConfig()).with_keep(keep)
    routed = route(messages, cfg)
    blocks = routed.where("selectable").select("conv_id", F.md5("content").alias("key"), F.col("content").alias("text"), "query").dropDuplicates(["conv_id", "key"])
    numbered = blocks.withColumn("block_id", F.concat_ws(":", F.col("conv_id").cast("string"), "key"))
    decided = select_blocks(numbered, keep, cfg, embed).where("changed").select("conv_id", "key", F.col("new_text").alias("_new"))
    joined = routed.withColumn("key", F.when(F.col("selectable"), F.md5("content"))).join(decided, ["conv_id", "key"], "left")
    return joined.select(*messages.columns, F.coalesce("_new", "content").alias("new_content"), F.col("_new").isNotNull().alias("changed"))


def trim_summary(trimmed: DataFrame, cfg: SelectionConfig | None = None) -> DataFrame:
    """Per conversation: ``tokens_saved`` (signed), ``chunks_dropped``, ``changed``."""
    marker = (cfg or SelectionConfig()).drop_marker
    saved = approx_tokens(F.coalesce("content", F.lit(""))) - approx_tokens(F.coalesce("new_content", F.lit("")))
    dropped = F.when(F.col("changed"), marker_total(F.col("new_content"), marker) - marker_total(F.col("content"), marker)).otherwise(0)
    return trimmed.groupBy("conv_id").agg(F.sum(saved).alias("tokens_saved"), F.sum(dropped).alias("chunks_dropped"), F.bool_or("changed").alias("changed"))


def make_transform(keep: float = 0.6, cfg: SelectionConfig | None = None, embed: Callable | None = None) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """A name and a function for ``DataFrame.transform``."""
    return "ctxsieve", lambda df: trim_messages(df, keep, cfg, embed)


def _texts(content, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of each trimmable string of a content value, at any depth."""
    if isinstance(content, str):
        yield path, content
    elif isinstance(content, list):
        for i, part in enumerate(content):
            if isinstance(part, dict):
                field = {"text": "text", "tool_result": "content"}.get(part.get("type"))
                if field:
                    yield from _texts(part.get(field), f"{path}/{i}/{field}")


def _patched(content, new: dict[str, str], path: str = ""):
    if isinstance(content, str):
        return new.get(path, content)
    if not isinstance(content, list):
        return content
    out = []
    for i, part in enumerate(content):
        field = {"text": "text", "tool_result": "content"}.get(part.get("type")) if isinstance(part, dict) else None
        out.append({**part, field: _patched(part.get(field), new, f"{path}/{i}/{field}")} if field and field in part else part)
    return out


def _parsed(raw: str | None):
    try:
        return None if raw is None else json.loads(raw)
    except ValueError:
        return None


def _said(content) -> str:
    """Text parts of a content value, without tool results."""
    if isinstance(content, str):
        return content
    parts = content if isinstance(content, list) else []
    return " ".join(p["text"] for p in parts if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str))


def trim_parts(messages: DataFrame, keep: float | Column = 0.6, cfg: SelectionConfig | None = None, embed: Callable | None = None) -> DataFrame:
    """As ``trim_messages`` for contents that are JSON: a string or a list of parts.

    Text parts and tool results are trimmed at any depth; other parts, other fields and
    invalid JSON pass through.  Selection itself stays in DataFrame functions.  ``keep`` may be a
    column of ``messages``.
    """
    ship(messages.sparkSession)
    fixed = isinstance(keep, (int, float))
    cfg = (cfg or SelectionConfig()).with_keep(keep) if fixed else cfg or SelectionConfig()

    @F.pandas_udf("string")
    def said(raw: pd.Series) -> pd.Series:
        return pd.Series([_said(_parsed(x)) for x in raw], dtype=object)

    @F.pandas_udf("array<struct<path: string, text: string>>")
    def texts(raw: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "text": t} for p, t in _texts(_parsed(x))] for x in raw], dtype=object)

    @F.pandas_udf("string")
    def patched(raw: pd.Series, new: pd.Series) -> pd.Series:
        out = [x if n is None else json.dumps(_patched(json.loads(x), dict(n)), ensure_ascii=False) for x, n in zip(raw, new)]
        return pd.Series(out, dtype=object)

    share = F.lit(float(keep)) if fixed else keep
    flat = messages.select("conv_id", "msg_idx", "role", "content", said("content").alias("said"), share.cast("double").alias("share"))
    conv, user = Window.partitionBy("conv_id"), F.col("role") == "user"
    asked = user & (strip(F.col("said")) != "")
    routed = flat.withColumn("last", F.max(F.when(user, F.col("msg_idx"))).over(conv)).withColumn(
        "query", F.max_by(F.when(asked, F.col("said")), F.when(asked, F.col("msg_idx"))).over(conv))
    open_ = routed.where(F.col("role").isin(*cfg.selectable_roles) & F.col("query").isNotNull() & F.coalesce(F.col("msg_idx") != F.col("last"), F.lit(True)))
    parts = open_.select("conv_id", "msg_idx", "query", "share", F.explode(texts("content")).alias("t")).select("conv_id", "msg_idx", "query", "share", "t.path", "t.text")
    parts = parts.where(F.char_length("text") >= cfg.min_message_chars).withColumn("block_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("msg_idx").cast("string"), "path"))
    decided = select_blocks(parts, F.col("share"), cfg, embed).where("changed")
    edits = decided.groupBy("conv_id", "msg_idx").agg(F.map_from_entries(F.collect_list(F.struct("path", "new_text"))).alias("edits"))
    joined = messages.join(edits, ["conv_id", "msg_idx"], "left")
    return joined.withColumn("changed", F.col("edits").isNotNull()).withColumn("new_content", patched("content", "edits")).drop("edits")
